"""Replay of recorded agent traces: observed evidence, grounding, stop reasons, accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SILENT_SCORE = 0.05


def compact_hits(hits: DataFrame, k: int = 5) -> DataFrame:
    """G1: the first `k` of ranked `hits(query, id, score, rank)`, scores to 4 places; a query that comes again counts once."""
    rows = hits.withColumn("query", F.lower("query")).where(F.col("rank") <= k)
    return rows.groupBy("query", "id").agg(F.round(F.max("score"), 4).alias("score"), F.min("rank").alias("rank"))


def search_calls(calls: DataFrame, per_turn: int = 4) -> DataFrame:
    """Of `calls(issue, turn, pos, query)` marks: `cached` - asked before, `over` - beyond the turn's limit."""
    q = F.lower(F.trim("query"))
    seen = F.row_number().over(Window.partitionBy("issue", q).orderBy("turn", "pos")) > 1
    nth = F.row_number().over(Window.partitionBy("issue", "turn").orderBy("pos"))
    return calls.withColumns({"cached": seen, "over": nth > per_turn})


def observed_scores(trace: DataFrame) -> DataFrame:
    """`issue, file, score, n` over `trace(issue, file, score)`; a result without score counts a little."""
    return trace.where("file IS NOT NULL").groupBy("issue", "file").agg(F.sum(F.coalesce("score", F.lit(SILENT_SCORE))).alias("score"), F.count("*").alias("n"))


def grounded(claimed: DataFrame, observed: DataFrame, confirmed: DataFrame, limit: int = 6, confirmed_only: bool = True) -> DataFrame:
    """Claimed files that were observed or confirmed, confirmed ones first, then by score.

    With `confirmed_only` an issue that has confirmed files, claimed or not, gives those of them that are claimed, and if
    there are none, all of them.
    """
    ok = confirmed.select("issue", "file", F.lit(True).alias("confirmed")).distinct()
    seen = observed.select("issue", "file", "score")
    claims = claimed.select("issue", "file", F.lit(True).alias("_claimed")).distinct()
    rows = claims.join(ok, ["issue", "file"], "full_outer").join(seen, ["issue", "file"], "left")
    rows = rows.withColumn("confirmed", F.coalesce("confirmed", F.lit(False))).where("confirmed OR score IS NOT NULL")
    of = lambda x: F.max(F.coalesce(x, F.lit(False))).over(Window.partitionBy("issue"))
    claimed_ok = F.coalesce("_claimed", F.lit(False))
    if confirmed_only:
        rows = rows.withColumns({"_any": of(F.col("confirmed")), "_both": of(F.col("confirmed") & claimed_ok)})
        rows = rows.where(F.when(F.col("_both"), F.col("confirmed") & claimed_ok).when(F.col("_any"), F.col("confirmed")).otherwise(claimed_ok))
    else:
        rows = rows.where(claimed_ok)
    rows = rows.select("issue", "file", "confirmed", F.coalesce("score", F.lit(0.0)).alias("score"))
    w = Window.partitionBy("issue").orderBy(F.col("confirmed").desc(), F.col("score").desc(), "file")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def stop_reason(trace: DataFrame, max_turns: int = 3, stagnation: int = 2, need_confirmed: bool = True, use_observed: bool = False) -> DataFrame:
    """Replay of `trace(issue, turn, file, confirmed, answer, named)`: `issue, turns, stop_reason`.

    A turn is an answer in text, which may name files, or calls that show files and may confirm them. An answer ends the run:
    with sufficient confidence if it names files after any calls, or if there are files to fall back to - confirmed or observed
    ones, as the mode says - and else by budget. Calls that show no new file stagnate; after so many such turns in a row the run
    ends by budget, but only where there are files to fall back to. A run that uses up its turns, or its record, ends by budget
    with files and by max_turns without.
    """
    false = F.lit(False)
    answer = F.coalesce("answer", false)
    calls = trace.withColumn("answer", answer).withColumn("file", F.when(~answer, F.col("file")))
    new = F.row_number().over(Window.partitionBy("issue", "file").orderBy("turn")) == 1
    turns = calls.withColumn("_new", (new & F.col("file").isNotNull()).cast("int")).groupBy("issue", "turn").agg(
        F.max("_new").alias("fresh"), F.max("answer").alias("answer"), F.max(F.coalesce("named", false)).alias("named"),
        F.max(F.coalesce("confirmed", false) & F.col("file").isNotNull()).alias("confirmed"),
    )
    w = Window.partitionBy("issue").orderBy("turn")
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumns({
        "nth": F.row_number().over(w), "_run": F.sum("fresh").over(so_far), "_last": F.lead("turn").over(w).isNull(),
        "called": F.coalesce(F.max(~F.col("answer")).over(before), false),
        "have": (F.lit(need_confirmed) & F.max("confirmed").over(so_far)) | (F.lit(use_observed) & (F.sum("fresh").over(so_far) > 0)),
    })
    flat = F.row_number().over(Window.partitionBy("issue", "_run").orderBy("turn")) - F.max("fresh").over(Window.partitionBy("issue", "_run"))
    turns = turns.withColumn("flat", flat)
    sure = (F.col("named") & F.col("called")) | F.col("have")
    why = (
        F.when(F.col("answer"), F.when(sure, "sufficient_confidence").otherwise("budget"))
        .when((F.col("flat") >= stagnation) & F.col("have"), "budget")
        .when((F.col("nth") >= max_turns) | F.col("_last"), F.when(F.col("have"), "budget").otherwise("max_turns"))
    )
    ended = turns.withColumn("why", why).where("why IS NOT NULL")
    return ended.groupBy("issue").agg(F.min("nth").alias("turns"), F.min_by("why", "nth").alias("stop_reason"))


def telemetry(calls: DataFrame) -> DataFrame:
    """Calls, cache hits, characters, and a map of calls by tool over `calls(issue, tool, cached, response)`."""
    t = calls.groupBy("issue", "tool").agg(F.count("*").alias("c"), F.count_if("cached").alias("h"), F.sum(F.length("response")).alias("x"))
    return t.groupBy("issue").agg(
        F.sum("c").alias("n_calls"), F.sum("h").alias("n_hits"), F.sum("x").alias("response_chars"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "c")))).alias("calls_by_tool"),
    )


def bounded(content: Column, limit: int = 200_000, marker: str = "\n... [truncated]") -> Column:
    """A file's text up to a limit."""
    return F.when(F.length(content) > limit, F.concat(F.substring(content, 1, limit), F.lit(marker))).otherwise(content)


def read_files(requests: DataFrame, files: DataFrame, limit: int = 200_000) -> DataFrame:
    """Requested paths of `files(path, content)`; paths that leave the root or are unknown get an error."""
    p = F.regexp_replace(F.trim("path"), r"^(\./)+", "")
    outside = p.startswith("/") | p.rlike(r"(^|/)\.\.(/|$)")
    rows = requests.withColumn("_p", p).join(files.select(F.col("path").alias("_p"), "content"), "_p", "left")
    error = F.when(outside, "outside").when(F.col("content").isNull(), "not found")
    return rows.select("path", F.when(error.isNull(), bounded(F.col("content"), limit)).alias("content"), error.alias("error"))
