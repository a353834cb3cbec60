"""Multi-signal fusion and staged localisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import confidence_label, excerpt, min_max, token_estimate, token_set
from graphloom.operators.push import named_files
from graphloom.storage import written

DENSE, LEXICAL, MODEL = 0.55, 0.30, 0.15


def candidate_pool(files: DataFrame, text: str, limit: int = 200) -> DataFrame:
    """`file, score, rank` - shared words of the path, its ending included, plus 2 where the text names it; zero scores stay."""
    shared = F.size(F.array_intersect(token_set("file"), token_set(F.lit(text))))
    score = (shared + F.when(F.instr(F.lit(text.lower()), F.lower("file")) > 0, 2).otherwise(0)).cast("double")
    best = files.select("file", score.alias("score")).orderBy(F.col("score").desc(), "file").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "file")))


def candidate_pools(files: DataFrame, queries: DataFrame, limit: int = 200) -> DataFrame:
    """F26 for each of `queries(query_id, text)`: `query_id, file, score, rank`.

    Files meet queries by the words that they share and by names that a text holds; where these are fewer than `limit`, the
    first of the other files in order follow with a score of zero.
    """
    files = written(files.select("file").where("file IS NOT NULL").distinct(), "pool-files")
    words = queries.select("query_id", F.explode(token_set("text")).alias("word"))
    shared = words.join(files.select("file", F.explode(token_set("file")).alias("word")), "word").groupBy("query_id", "file").agg(F.count("*").alias("n"))
    shared = shared.unionByName(named_files(files, queries).withColumn("n", F.lit(2).cast("long")))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "file")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    best = shared.groupBy("query_id", "file").agg(F.sum("n").cast("double").alias("score"))
    best = written(ranked(best).drop("rank"), "pool-best")
    short = queries.select("query_id").distinct().join(best.groupBy("query_id").agg(F.count("*").alias("m")), "query_id", "left").where(F.coalesce("m", F.lit(0)) < limit)
    first = F.broadcast(files.orderBy("file").limit(2 * limit))
    more = short.select("query_id").crossJoin(first).join(best.select("query_id", "file"), ["query_id", "file"], "left_anti").withColumn("score", F.lit(0.0))
    return ranked(best.unionByName(more.select("query_id", "file", "score")))


def fused(dense: DataFrame, lexical: DataFrame, model: DataFrame, by: list[str], limit: int = 12) -> DataFrame:
    """dense(by, file, score), lexical and model(by, file, rank): weighted sum, full outer; `score, rank`.

    Dense scores are brought to 0..1; a rank i of n counts 1 - (i - 1) / n.
    """
    w = Window.partitionBy(*by)
    d = dense.select(*by, "file", min_max("score", w).alias("d"))
    of_rank = lambda df, name: df.select(*by, "file", (1 - (F.col("rank") - 1) / F.count("*").over(w)).alias(name))
    rows = d.join(of_rank(lexical, "l"), [*by, "file"], "full_outer").join(of_rank(model, "m"), [*by, "file"], "full_outer")
    zero = F.lit(0.0)
    score = DENSE * F.coalesce("d", zero) + LEXICAL * F.coalesce("l", zero) + MODEL * F.coalesce("m", zero)
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "file")
    rows = rows.select(*by, "file", F.round(score, 6).alias("score"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def first_symbol(symbols: DataFrame) -> DataFrame:
    """of `symbols(file, name, start_line)` the first by line and name."""
    return symbols.groupBy("file").agg(F.min_by("name", F.struct("start_line", "name")).alias("symbol"), F.min("start_line").alias("start_line"))


def symbol_pool(symbols: DataFrame, per_file: int = 6) -> DataFrame:
    """the first symbols of each file."""
    w = Window.partitionBy("file").orderBy("start_line", "name")
    return symbols.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= per_file)


def validated(choices: DataFrame, pool: DataFrame, on: list[str]) -> DataFrame:
    """Choices that the pool holds."""
    return choices.join(pool, on, "left_semi")


def sampled_spans(symbols: DataFrame, k: int = 4, margin: int = 10) -> DataFrame:
    """`k` symbols an issue, in the order of a hash of both, with lines around them. The order is this engine's own."""
    w = Window.partitionBy("issue_id").orderBy(F.sha2(F.concat_ws("\u0001", "issue_id", "file", "name"), 256), "file", "name")
    rows = symbols.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)
    return rows.withColumns({"start": F.greatest(F.col("start_line") - margin, F.lit(1)), "end": F.col("end_line") + margin})


def validated_spans(answers: DataFrame, pool: DataFrame, k: int = 4) -> DataFrame:
    """F32: `answers(issue_id, answer)` - JSON lists of symbol_id, start, end, confidence - against `pool(issue_id, symbol_id)`.

    `issue_id, spans, violations`: entries that are no object, name no symbol of the pool or have a confidence outside 0..1 count
    as violations; the first `k` others stay. A text that is no list is one violation.
    """
    kind = "array<string>"
    rows = answers.select("issue_id", F.from_json("answer", kind).alias("a"))
    lost = rows.where("a IS NULL").select("issue_id", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("e"))
    each = rows.select("issue_id", F.posexplode("a").alias("pos", "e")).unionByName(lost)
    got = each.withColumn("s", F.from_json("e", "symbol_id string, start int, end int, confidence double"))
    known = pool.select("issue_id", F.col("symbol_id").alias("known")).distinct()
    got = got.join(known, (got.issue_id == known.issue_id) & (got.s.symbol_id == known.known), "left").select(got.issue_id, "pos", "s", "known")
    ok = F.col("known").isNotNull() & F.coalesce(F.col("s.confidence").between(0, 1), F.lit(False))
    got = got.withColumn("ok", ok)
    good = F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("pos", "s"))))
    return got.groupBy("issue_id").agg(
        F.transform(F.slice(good, 1, k), lambda x: x["s"]).alias("spans"), F.count_if(~F.col("ok")).cast("int").alias("violations")
    )


def greedy_budget(lines: Column, budget: int = 1200) -> Column:
    """F33 over an ordered array of lines: a line that would pass the budget is left out, later ones may still fit.

    Lines without cost always fit. Of the others no more than `budget` can, and the state holds the places of these alone.
    """
    cost = F.transform(lines, token_estimate)
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("kept"))
    step = lambda s, c: F.struct(
        F.when(s["spent"] + c <= budget, s["spent"] + c).otherwise(s["spent"]).alias("spent"), (s["at"] + 1).alias("at"),
        F.when((c > 0) & (s["spent"] + c <= budget), F.concat(s["kept"], F.array(s["at"]))).otherwise(s["kept"]).alias("kept"),
    )
    places = F.aggregate(cost, start, step, lambda s: s["kept"])
    # one element binds the places, so that they are found once
    return F.flatten(F.transform(F.array(places), lambda p: F.filter(lines, lambda x, i: (token_estimate(x) == 0) | F.array_contains(p, i))))


def span_excerpts(spans: DataFrame, chunks: DataFrame, bucket: int = 256) -> DataFrame:
    """for each span(span_id, file, symbol, start, end) the first overlapping chunk(file, name, text, start_line, end_line),
    or else the first whose name holds the symbol.

    Overlaps are found by an equi-join on the file and on buckets of lines that both touch.
    """
    steps = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket)))
    c = chunks.select("file", "name", "text", "start_line", "end_line")
    over = spans.withColumn("_b", steps("start", "end")).join(c.withColumn("_b", steps("start_line", "end_line")), ["file", "_b"])
    over = over.where("start_line <= end AND end_line >= start")
    named = spans.join(c, "file").where(F.col("name").contains(F.col("symbol")))
    pick = F.struct("prio", "start_line", "end_line", "name", "text")
    rows = over.withColumn("prio", F.lit(0)).drop("_b").unionByName(named.withColumn("prio", F.lit(1)))
    best = rows.groupBy("span_id").agg(F.min(pick).alias("p"))
    return spans.join(best, "span_id", "left").select(*spans.columns, F.col("p.name").alias("chunk"), excerpt("p.text").alias("excerpt"))


def final_files(spans: Column, symbols: Column, stage1: Column, limit: int = 12) -> Column:
    """files of the spans, or if there are none, of the symbols, or else of the first stage, by first appearance."""
    first = F.coalesce(*(F.when(F.size(x) > 0, x) for x in (spans, symbols, stage1)), F.array().cast("array<string>"))
    return F.slice(F.array_distinct(first), 1, limit)


def candidate_cut(ranked: DataFrame, k: int = 10, by: list[str] | None = None) -> DataFrame:
    """of `ranked(by, file, score)` the first 3 `k` as candidates, the first `k` of them `chosen`."""
    w = Window.partitionBy(*(by or [])).orderBy(F.col("score").desc(), "file")
    if not by:
        ranked = ranked.orderBy(F.col("score").desc(), "file").limit(3 * k)
    rows = ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 3 * k)
    return rows.withColumn("chosen", F.col("rank") <= k)


def span_confidence(score: Column) -> Column:
    return confidence_label(score)
