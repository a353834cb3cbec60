"""Graph analytics over `nodes(id, type, name, file, ...)` and `edges(src, dst, type, confidence)`."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import confidence_label, confidence_weight, is_test_file, min_max, path_tokens, token_estimate, token_set
from graphloom.storage import discard, written

#: Files of a folder that meet one file at a time.
MODULE_BLOCK = 1_000
#: Ranks (of about 60 bytes) up to which they are broadcast to the links.
BROADCAST_RANKS = 500_000
#: Nodes (of about 100 bytes) up to which they are broadcast to the edges.
BROADCAST_NODES = 500_000
# Fixed values of the score, and of what the tools show in either mode.
WEIGHTS = {"sem": 0.35, "graph": 0.30, "conf": 0.20, "hint": 0.10, "pen": 0.05}
NEIGHBOR_TOOL = {"progressive": {"cap": 10, "doc_chars": 40}, "baseline": {"cap": 20, "doc_chars": 60}}
FILE_SUMMARY = {"progressive": {"total": 8, "per_class": 4, "doc_chars": 50}, "baseline": {"total": 12, "per_class": 6, "doc_chars": 80}}


def both_ways(edges: DataFrame) -> DataFrame:
    """`id, other, direction, type, confidence`; an edge without label is of medium confidence."""
    conf = F.lower(F.coalesce(F.nullif("confidence", F.lit("")), F.lit("medium"))).alias("confidence")
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit("out").alias("direction"), "type", conf)
    back = edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit("in").alias("direction"), "type", conf)
    return out.unionByName(back)


def capped_neighbors(edges: DataFrame, cap: int = 12, types: Sequence[str] | None = None) -> DataFrame:
    """each node's first `cap` neighbours by id, type and weight of the confidence: `id, other, type, confidence, pos`.

    A neighbour in both directions counts twice.
    """
    e = both_ways(edges if types is None else edges.where(F.col("type").isin(list(types))))
    e = e.select("id", "other", "type", "confidence")
    w = Window.partitionBy("id").orderBy("other", "type", confidence_weight("confidence"), "confidence")
    return e.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= cap)


def bounded_paths(edges: DataFrame, seeds: DataFrame, depth: int = 2, cap: int = 12, types: Sequence[str] | None = None) -> DataFrame:
    """the first shortest path from each seed to each node within `depth` steps.

    `seeds(query_id, node_id)` gives `query_id, seed, node, depth, edge_types, confidences`. A level is one equi-join with
    the capped neighbours; of several ways to a node the one whose parent was visited first, then the parent's neighbour
    order, stays - the order that a queue would visit them in.
    """
    near = written(capped_neighbors(edges, cap, types), "near")  # every level reads them
    none = F.array().cast("array<string>")
    level = seeds.select("query_id", F.col("node_id").alias("seed"), F.col("node_id").alias("node")).distinct().select(
        "*", F.lit(0).alias("depth"), none.alias("edge_types"), none.alias("confidences"), F.array(F.lit(0)).alias("visit")
    )
    seen = level
    for d in range(1, depth + 1):
        step = level.join(near, level.node == near.id).select(
            "query_id", "seed", F.col("other").alias("node"), F.lit(d).alias("depth"),
            F.concat("edge_types", F.array("type")).alias("edge_types"), F.concat("confidences", F.array("confidence")).alias("confidences"),
            F.concat("visit", F.array("pos")).alias("visit"),
        )
        best = step.groupBy("query_id", "seed", "node").agg(F.min(F.struct("visit", "depth", "edge_types", "confidences")).alias("p"))
        level = best.select("query_id", "seed", "node", "p.depth", "p.edge_types", "p.confidences", "p.visit").join(
            seen.select("query_id", "seed", "node"), ["query_id", "seed", "node"], "left_anti"
        )
        level = written(level, "level") if d < depth else level
        seen = seen.unionByName(level)
    return seen.drop("visit")


def path_confidence(edge_types: Column, confidences: Column) -> Column:
    """the mean over the calls, or else over all edges, or else 1."""
    pairs = F.arrays_zip(edge_types.alias("t"), confidences.alias("c"))
    weight = lambda xs: F.transform(xs, lambda p: confidence_weight(p["c"]))
    mean = lambda ws: F.aggregate(ws, F.lit(0.0), lambda s, x: s + x) / F.size(ws)
    calls = weight(F.filter(pairs, lambda p: p["t"] == "CALLS"))
    every = weight(pairs)
    return F.when(F.size(calls) > 0, mean(calls)).when(F.size(every) > 0, mean(every)).otherwise(1.0)


def file_of_nodes(nodes: DataFrame) -> DataFrame:
    """`node, file` of nodes that lie in a known Python file."""
    files = nodes.where((F.col("type") == "file") & F.col("id").endswith(".py")).select(F.col("id").alias("file"))
    of = nodes.select(F.col("id").alias("node"), F.when(F.col("type") == "file", F.col("id")).otherwise(F.col("file")).alias("file"))
    return of.join(files, "file", "left_semi")


def hub_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`file, degree` - ends of edges at the file and at the nodes in it."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.join(file_of_nodes(nodes), "node").groupBy("file").agg(F.count("*").alias("degree"))


def evidence(paths: DataFrame, seeds: DataFrame, node_files: DataFrame) -> DataFrame:
    """paths gathered by `query_id, file`; a path is high, medium or low by its own confidence.

    `seeds(query_id, node_id, score)` have scores in 0..1.
    """
    s = seeds.select("query_id", F.col("node_id").alias("seed"), F.col("score").alias("seed_score"))
    rows = paths.join(s, ["query_id", "seed"]).join(node_files, "node")
    conf = path_confidence(F.col("edge_types"), F.col("confidences"))
    return rows.withColumn("conf", conf).withColumn("label", confidence_label("conf")).groupBy("query_id", "file").agg(
        F.count("*").alias("n_paths"),
        F.size(F.array_distinct(F.flatten(F.collect_set("edge_types")))).alias("n_types"),
        F.max(F.col("seed_score") / (F.col("depth") + 1)).alias("s_sem"),
        F.avg("conf").alias("s_conf"),
        F.avg(F.col("depth").cast("double")).alias("avg_depth"),
        F.count_if(F.col("label") == "low").alias("n_low"),
        F.count_if(F.col("label") == "high").alias("n_high"),
    )


@dataclass(frozen=True)
class Scoring:
    hub_threshold: int = 20
    hub_scale: float = 0.35
    weights: tuple[tuple[str, float], ...] = tuple(WEIGHTS.items())
    ratio: float = 0.70
    min_cut: float = 0.0
    min_return: int = 1
    max_return: int = 6


def evidence_score(found: DataFrame, hints: DataFrame, degrees: DataFrame, how: Scoring | None = None) -> DataFrame:
    """`found` of F13 with `s_graph, s_hint, s_pen, score`. `hints(query_id, tokens)` holds the query's words."""
    how = how or Scoring()
    w = dict(how.weights)
    g = F.log1p(F.col("n_paths").cast("double")) + 0.25 * F.least("n_types", F.lit(3)) / 3
    rows = found.join(hints, "query_id", "left").join(degrees, "file", "left").withColumn("_g", g)
    words = path_tokens("file")
    hint = F.when(F.size(words) > 0, F.size(F.array_intersect(words, F.coalesce("tokens", F.array().cast("array<string>")))) / F.size(words)).otherwise(0.0)
    deg, t = F.coalesce("degree", F.lit(0)), how.hub_threshold
    hub = F.when(deg > t, F.least((deg - t) / F.lit(float(t)), F.lit(1.0))).otherwise(0.0)
    base = F.when(F.col("n_low") == F.col("n_paths"), 1.0).otherwise(F.greatest(F.lit(0.0), F.col("n_low") / F.col("n_paths") - 0.7))
    top = F.max("_g").over(Window.partitionBy("query_id"))
    rows = rows.withColumns({
        "s_graph": F.when(top > 0, F.col("_g") / top).otherwise(0.0), "s_hint": hint, "s_pen": F.least(F.lit(1.0), base + how.hub_scale * hub),
    })
    score = w["graph"] * F.col("s_graph") + w["sem"] * F.col("s_sem") + w["conf"] * F.col("s_conf") + w["hint"] * F.col("s_hint") - w["pen"] * F.col("s_pen")
    return rows.withColumn("score", F.round(score, 6)).drop("_g", "tokens", "degree")


def adaptive_cut(scored: DataFrame, how: Scoring | None = None) -> DataFrame:
    """F16: ranked; the first few, and then those that score enough beside the best, up to a limit."""
    how = how or Scoring()
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("n_high").desc(), "avg_depth", "file")
    rows = scored.withColumn("rank", F.row_number().over(w)).withColumn("_top", F.first("score").over(w))
    enough = F.col("score") >= F.greatest(F.lit(how.min_cut), F.col("_top") * how.ratio)
    return rows.where((F.col("rank") <= how.max_return) & ((F.col("rank") <= how.min_return) | enough)).drop("_top")


def seeds_of(ranked: DataFrame, k: int = 8) -> DataFrame:
    """the best `k` of `ranked(query_id, node_id, score)`, scores brought to 0..1."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "node_id")
    best = ranked.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
    return best.withColumn("score", min_max("score", Window.partitionBy("query_id")))


def retrieve(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, issues: DataFrame, depth: int = 2, cap: int = 12, how: Scoring | None = None) -> DataFrame:
    """The deterministic graph method: seeds, paths, evidence, score, cut. `issues(query_id, text)`."""
    found = evidence(bounded_paths(edges, seeds, depth, cap), seeds, file_of_nodes(nodes))
    hints = issues.select("query_id", token_set("text").alias("tokens"))
    return adaptive_cut(evidence_score(found, hints, hub_degree(nodes, edges), how), how)


def weighted_file_graph(nodes: DataFrame, edges: DataFrame, same_module: bool = False) -> DataFrame:
    """`src, dst, weight, n_import, n_symbol, n_test` between files; edges inside a file are dropped."""
    of = written(file_of_nodes(nodes), "file-of")
    got = _file_links(edges, of.withColumn("test", is_test_file("file")))
    return _with_modules(got, of.select("file").distinct()) if same_module else got


def numbered_file_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """F18 with numbers for `src` and `dst`, which are less to move than paths; and the files that have them: `file, id`."""
    of = written(file_of_nodes(nodes), "file-of")
    names = written(of.select("file").distinct().select("file", F.monotonically_increasing_id().alias("id")), "file-names")
    of = of.join(names, "file").select("node", F.col("id").alias("file"), is_test_file("file").alias("test"))
    return _file_links(edges, written(of, "file-numbers")), names


def _file_links(edges: DataFrame, of: DataFrame) -> DataFrame:
    """Links between the files of `of(node, file, test)`. Many nodes are not sorted with the edges: a task holds its share of them.

    Ends come before sources, so that edges of a source lie together when they are added up.
    """
    few = of.count() <= BROADCAST_NODES
    at = lambda end: of.select(F.col("node").alias(end), F.col("file").alias(f"_{end}"), F.col("test").alias(f"_{end}_test")).hint("broadcast" if few else "shuffle_hash")
    e = edges.select("src", "dst", "type").join(at("dst"), "dst").drop("dst").join(at("src"), "src").where("_src <> _dst")
    kind = F.when(F.col("type") == "IMPORTS", "import").when(F.col("_src_test") & ~F.col("_dst_test"), "test")
    kind = kind.when(F.col("type").isin("CALLS", "INHERITS", "CONTAINS", "DEFINES"), "symbol")
    e = e.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), kind.alias("kind")).where("kind IS NOT NULL")
    weight = F.when(F.col("kind") == "test", 0.5).otherwise(1.0)
    count = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    return e.groupBy("src", "dst").agg(F.sum(weight).alias("weight"), count("import"), count("symbol"), count("test"))


def _with_modules(graph: DataFrame, files: DataFrame, weight: float = 0.2) -> DataFrame:
    """`graph` with `weight` more between any two files of a folder.

    These pairs are the square of a folder by definition. They are made from each file and blocks of MODULE_BLOCK files of its folder, with the links from the
    file into the block beside it, so that pairs are never shuffled or summed up and no task has a folder to itself.
    """
    folder = lambda c: F.regexp_replace(c, "[^/]*$", "")
    own = files.select("file", folder("file").alias("dir"))
    n_blocks = own.groupBy("dir").agg(F.ceil(F.count("*") / MODULE_BLOCK).alias("n_blocks"))
    own = written(own.join(F.broadcast(n_blocks), "dir") if n_blocks.count() <= BROADCAST_RANKS else own.join(n_blocks, "dir"), "module-files")
    block = F.expr("pmod(xxhash64(dst), n_blocks)").alias("block")
    blocks = own.select("dir", "n_blocks", F.col("file").alias("dst")).select("dir", block, "dst").groupBy("dir", "block").agg(F.collect_list("dst").alias("files"))
    same = F.col("dir") == folder("dst")
    graph = written(graph.withColumn("dir", folder("src")), "module-links")
    values = [c for c in graph.columns if c not in ("src", "dst", "dir")]
    linked = graph.where(same).join(own.select(F.col("file").alias("src"), "n_blocks"), "src").select("src", block, F.struct("dst", *values).alias("x"))
    linked = linked.groupBy("src", "block").agg(F.map_from_entries(F.collect_list(F.struct("x.dst", "x"))).alias("linked"))
    each = own.select(F.col("file").alias("src"), "dir", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
    met = each.join(linked, ["src", "block"], "left").repartition("src", "block")
    met = met.join(F.broadcast(blocks) if own.count() <= BROADCAST_RANKS else blocks, ["dir", "block"])
    pairs = met.select("src", "linked", F.explode("files").alias("dst")).where("src <> dst").withColumn("x", F.try_element_at("linked", "dst"))
    told = [F.coalesce(F.col(f"x.{c}"), F.lit(0)).cast(graph.schema[c].dataType).alias(c) for c in values]
    pairs = pairs.select("src", "dst", *told).withColumn("weight", F.col("weight") + weight)
    return graph.where(~same).drop("dir").unionByName(pairs)


def row_normalized(graph: DataFrame) -> DataFrame:
    """F20."""
    return graph.withColumn("p", F.col("weight") / F.sum("weight").over(Window.partitionBy("src")))


def packed_links(links: DataFrame) -> DataFrame:
    """`links(src, dst, p)` or `graph(src, dst, weight)`, the latter normalised (F20), with one row a source: `src, links` of `dst, p`."""
    if "p" in links.columns:
        return links.groupBy("src").agg(F.collect_list(F.struct("dst", "p")).alias("links"))
    each = links.groupBy("src").agg(F.collect_list(F.struct("dst", "weight")).alias("links"), F.sum("weight").alias("_all"))
    return each.select("src", F.transform("links", lambda x: F.struct(x["dst"].alias("dst"), (x["weight"] / F.col("_all")).alias("p"))).alias("links"))


def personalization(files: DataFrame, text: str) -> DataFrame:
    """`file, p` - shared words of the path, its ending included, plus 3 where the text names it; uniform where there is nothing."""
    shared = F.size(F.array_intersect(token_set("file"), token_set(F.lit(text)))).cast("double")
    raw = files.select("file", (shared + F.when(F.instr(F.lit(text.lower()), F.lower("file")) > 0, 3.0).otherwise(0.0)).alias("raw"))
    total = raw.agg(F.sum("raw").alias("total"), F.count("*").alias("n"))
    return raw.crossJoin(F.broadcast(total)).select("file", F.when(F.col("total") > 0, F.col("raw") / F.col("total")).otherwise(1 / F.col("n")).alias("p"))


def personalizations(files: DataFrame, queries: DataFrame) -> DataFrame:
    """F21 for each of `queries(query_id, text)`: `query_id, file, p`. Every query ranks all files, so both meet in full."""
    asked = queries.select("query_id", token_set("text").alias("_words"), F.lower("text").alias("_text"))
    rows = files.select("file", token_set("file").alias("_own")).crossJoin(asked)
    named = F.when(F.contains("_text", F.lower("file")), 3.0).otherwise(0.0)
    rows = rows.select("query_id", "file", (F.size(F.array_intersect("_own", "_words")) + named).alias("raw"))
    total = rows.groupBy("query_id").agg(F.sum("raw").alias("total"), F.count("*").alias("n"))
    return rows.join(total, "query_id").select("query_id", "file", F.when(F.col("total") > 0, F.col("raw") / F.col("total")).otherwise(1 / F.col("n")).alias("p"))


def pagerank(
    graph: DataFrame, person: DataFrame, alpha: float = 0.85, iterations: int = 100, tolerance: float = 1e-6, check: int = 3, by: Sequence[str] = ()
) -> DataFrame:
    """`by, file, rank` by power iteration of `graph(src, dst, weight)` with restarts and dangling mass by `person(by, file, p)`.

    With `by`, one ranking for each of its values, all in the same steps until the last has converged. Every `check` steps
    the ranks are written to the checkpoint folder, which cuts the lineage, and the change is tested.
    """
    links = written(packed_links(graph), "links")
    node = written(person.select(*by, "file", "p"), "nodes")
    sizes = node.groupBy(*by).agg(F.count("*").alias("n"))
    few = node.count() <= BROADCAST_RANKS
    ranks = (node.join(sizes, list(by)) if by else node.crossJoin(F.broadcast(sizes))).select(*by, "file", "p", (1.0 / F.col("n")).alias("r"))
    done, open_, old = 0, node.limit(1).count() > 0, None
    while open_ and done < iterations:
        steps = min(check, iterations - done)
        nxt = written(_steps(ranks, links, steps, alpha, by, few), "ranks")
        done += steps
        moved = nxt.join(ranks.select(*by, "file", F.col("r").alias("old")), [*by, "file"]).groupBy(*by).agg(F.sum(F.abs(F.col("r") - F.col("old"))).alias("d"), F.count("*").alias("n"))
        ranks = nxt
        open_ = moved.where(F.col("d") >= tolerance * F.col("n")).limit(1).count() > 0
        if old is not None:
            discard(old)
        old = nxt
    total = ranks.groupBy(*by).agg(F.sum("r").alias("total"))
    return (ranks.join(total, list(by)) if by else ranks.crossJoin(F.broadcast(total))).select(*by, "file", (F.col("r") / F.col("total")).alias("rank"))


def _steps(ranks: DataFrame, links: DataFrame, steps: int, alpha: float, by: Sequence[str] = (), few: bool = False) -> DataFrame:
    """`steps` iterations of `ranks(by, file, p, r)` over packed links. Ranks sum to 1, so the dangling mass is what links did not carry on.

    Links are not shuffled where ranks are few, and what they carry is summed up before it is.
    """
    for _ in range(steps):
        have = ranks.select(*by, F.col("file").alias("src"), "r")
        met = links.join(F.broadcast(have) if few else have, "src").select(*by, "r", F.explode("links").alias("x"))
        got = met.groupBy(*by, F.col("x.dst").alias("file")).agg(F.sum(F.col("r") * F.col("x.p")).alias("got"))
        carried = got.groupBy(*by).agg(F.sum("got").alias("carried"))
        lost = F.lit(1.0) - F.coalesce("carried", F.lit(0.0))
        new = F.lit(1 - alpha) * F.col("p") + F.lit(alpha) * (F.coalesce("got", F.lit(0.0)) + lost * F.col("p"))
        ranks = ranks.select(*by, "file", "p").join(got, [*by, "file"], "left")
        ranks = (ranks.join(carried, list(by), "left") if by else ranks.crossJoin(F.broadcast(carried))).select(*by, "file", "p", new.alias("r"))
    return ranks


def pagerank_fixed(links: DataFrame, person: DataFrame, steps: int, alpha: float = 0.85) -> DataFrame:
    """`steps` iterations over `links(src, dst, p)`, or over the same packed: `file, rank`."""
    links = links if "links" in links.columns else packed_links(links)
    start = person.select("file", "p").crossJoin(F.broadcast(person.agg(F.count("*").alias("n")))).select("file", "p", (1.0 / F.col("n")).alias("r"))
    return _steps(start, links, steps, alpha, few=person.count() <= BROADCAST_RANKS).select("file", F.col("r").alias("rank"))


def budget_prefix(lines: DataFrame, budget: int, group: Sequence[str] = ()) -> DataFrame:
    """ranked `lines(rank, line)` until their running cost (estimate + 1) passes the budget."""
    w = Window.partitionBy(*group).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("spent", F.sum(token_estimate("line") + 1).over(w)).where(F.col("spent") <= budget)


def top_symbols(nodes: DataFrame, k: int = 6) -> DataFrame:
    """`file, symbols` - the first distinct names of each file."""
    return nodes.where("name IS NOT NULL AND type <> 'file'").groupBy("file").agg(F.slice(F.array_sort(F.collect_set("name")), 1, k).alias("symbols"))


def _described(nodes: DataFrame) -> DataFrame:
    """With the columns that not every graph has."""
    return nodes.withColumns({c: F.lit(None).cast("string") for c in ("docstring", "signature") if c not in nodes.columns})


def _asked(spark: SparkSession, column: str, asked: DataFrame | str) -> DataFrame:
    """One value, or a table of them, each once."""
    if isinstance(asked, str):
        return spark.createDataFrame([(asked,)], f"{column} string")
    return asked.select(F.col(column).cast("string").alias(column)).where(F.col(column).isNotNull()).distinct()


def neighbor_tool(nodes: DataFrame, edges: DataFrame, asked: DataFrame | str, mode: str = "progressive") -> DataFrame:
    """Neighbours of each of `asked(node_id)`, or of one node, outgoing first: `node_id, id, direction, type, name, node_type,
    file, docstring, pos`; one row of `error` for a node that is unknown. A neighbour without file stands under its own id.

    All nodes that are asked for are one plan: edges meet them by either end, and a node's first neighbours are kept. Only what
    they are ordered by is there until then; what is told of them meets those that are kept.
    """
    cap, doc_chars = NEIGHBOR_TOOL[mode]["cap"], NEIGHBOR_TOOL[mode]["doc_chars"]
    nodes, asked = _described(nodes), _asked(nodes.sparkSession, "node_id", asked)
    known = asked.join(nodes.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_semi")
    ends = lambda own, other, way: edges.select(F.col(own).alias("node_id"), F.col(other).alias("id"), F.lit(way).alias("direction"), "type")
    around = ends("src", "dst", "outgoing").unionByName(ends("dst", "src", "incoming")).join(known, "node_id", "left_semi").distinct()
    said = F.substring(F.coalesce("docstring", F.lit("")), 1, doc_chars).alias("docstring")
    # Rows have numbers, as an id may have several.
    about = nodes.select("id", F.coalesce("file", "id").alias("file"), "name", F.col("type").alias("node_type"), said, F.monotonically_increasing_id().alias("_row"))
    about = written(about, "about")
    rows = around.join(about.select("id", "file", "_row"), "id", "left").withColumn("file", F.coalesce("file", "id"))
    w = Window.partitionBy("node_id").orderBy(F.col("direction").desc(), "file", "id", "type")
    rows = rows.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= cap)
    rows = rows.join(about.select("_row", "name", "node_type", "docstring"), "_row", "left").drop("_row").withColumn("error", F.lit(None).cast("string"))
    bad = asked.join(known, "node_id", "left_anti").select("node_id", F.concat(F.lit("unknown node: "), "node_id").alias("error"))
    return rows.unionByName(bad, allowMissingColumns=True)


def file_summary(nodes: DataFrame, edges: DataFrame, asked: DataFrame | str, mode: str = "progressive") -> DataFrame:
    """`path, file, id, name, type, docstring, signature, methods, pos` of what the file of each of `asked(path)`, or of one path,
    defines; a path may be the end of a file's. Functions show their signature, classes their methods' names and
    signatures. One row of `error` for a path that no file has.

    Paths meet files by equality on the ends of the files' paths; a whole path comes before an end, then the least file.
    """
    total, per_class, doc_chars = (FILE_SUMMARY[mode][k] for k in ("total", "per_class", "doc_chars"))
    nodes, asked = _described(nodes), _asked(nodes.sparkSession, "path", asked)
    files = nodes.where("type = 'file'").select(F.col("id").alias("file"), F.split("id", "/").alias("parts"))
    cut = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", i, F.size("parts")), "/"))
    ends = files.select("file", F.explode(cut).alias("path"))
    file = asked.join(ends, "path").groupBy("path").agg(F.min_by("file", F.struct(F.col("file") != F.col("path"), "file")).alias("file"))
    kids = file.join(edges.where("type = 'DEFINES'").select(F.col("src").alias("file"), F.col("dst").alias("id")), "file")
    signed = F.coalesce("signature", F.lit(""))
    named = nodes.select(
        "id", "name", "type", F.substring(F.coalesce("docstring", F.lit("")), 1, doc_chars).alias("docstring"),
        F.when(F.col("type") == "function", signed).alias("signature"),
    )
    methods = edges.where("type = 'CONTAINS'").join(nodes.select(F.col("id").alias("dst"), F.struct("name", signed.alias("signature")).alias("method")), "dst")
    first = Window.partitionBy("src").orderBy("method")
    methods = methods.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= per_class)
    methods = methods.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("method")).alias("methods"))
    rows = kids.join(named, "id").join(methods, "id", "left").withColumn("methods", F.when(F.col("type") == "class", F.col("methods")))
    w = Window.partitionBy("path").orderBy("name", "id")
    rows = rows.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= total)
    bad = asked.join(file, "path", "left_anti").select("path", F.concat(F.lit("unknown file: "), "path").alias("error"))
    return rows.withColumn("error", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)
