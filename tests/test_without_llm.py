"""The rest works where the training-data folders are not there."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_them(tmp_path):
    shutil.copytree(f"{ROOT}/graphloom", tmp_path / "graphloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not any(n.startswith('op1_') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    for extra in ("", "corpus_pipeline.py"):
        if extra and os.path.exists(f"{ROOT}/{extra}"):
            shutil.copy(f"{ROOT}/{extra}", tmp_path)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
