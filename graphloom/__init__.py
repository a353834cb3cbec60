"""graphloom: retrieval, graph, evaluation and telemetry analytics as PySpark DataFrames."""
