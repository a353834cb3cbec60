"""Line dedup by pairwise alignment.

Documents that share a rare line are aligned, line by line, with a patience diff: lines that occur once in either
document are anchors, the longest increasing run of anchors is kept, and the gaps between them are treated likewise.
Blocks of consecutive aligned lines that are long enough are deleted from the later document of the two. The earliest
holder of a block keeps it: its copy could only be deleted for a still earlier one.

Pairs come from equi-joins on line hashes. Lines of up to RARE documents pair all their holders; a more frequent line
pairs each holder with the first holder and with one earlier holder, which settles nearly all blocks of frequent lines.

The others are settled exactly. Two documents without a rare line in common are aligned by their frequent lines alone, so
each is replaced by its outline: frequent lines and the blank lines beside them, with one gap for whatever else lies
between. Many documents have the same outline. Where a run of frequent lines that is long enough to be a block is not
deleted yet, outlines that hold the run are aligned instead of documents, each early one standing for its documents that
share no rare line with the later document. Only line hashes travel until the deletions are known.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_back, map_arrow, pieces, row_key, text_of, with_counts, written

#: Holders up to which all pairs of a line are aligned.
RARE = 12
#: Code points, without white space at the ends of lines, that a deleted block holds at least.
LEAST_CHARS = 40
#: Stands in an outline for lines that are not frequent.
GAP = 1


def patience(a: list[int], b: list[int], skip: int = 0) -> list[tuple[int, int]]:
    """Aligned positions of equal entries, increasing in both; entries equal to `skip` align only beside others."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and a[lo] == b[low]:
            out.append((lo, low))
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and a[hi - 1] == b[high - 1]:
            hi, high = hi - 1, high - 1
            out.append((hi, high))
        if lo >= hi or low >= high:
            continue
        once_a, once_b = Counter(a[lo:hi]), Counter(b[low:high])
        at_b = {x: j for j, x in enumerate(b[low:high], low) if once_b[x] == 1}
        anchors = [(i, at_b[x]) for i, x in enumerate(a[lo:hi], lo) if once_a[x] == 1 and x in at_b and x != skip]
        if not anchors:
            continue
        tails: list[int] = []
        ends: list[int] = []
        back = [-1] * len(anchors)
        for k, (_, j) in enumerate(anchors):
            p = bisect_left(tails, j)
            back[k] = ends[p - 1] if p else -1
            tails[p : p + 1], ends[p : p + 1] = [j], [k]
        chain, k = [], ends[-1]
        while k >= 0:
            chain.append(anchors[k])
            k = back[k]
        at, to = lo, low
        for i, j in reversed(chain):
            out.append((i, j))
            todo.append((at, i, to, j))
            at, to = i + 1, j + 1
        todo.append((at, hi, to, high))
    return sorted(out)


def blocks(aligned: list[tuple[int, int]], sizes: list[int], least: int = LEAST_CHARS) -> list[int]:
    """Lines of the first document in runs of consecutive aligned lines that hold at least `least` characters."""
    out: list[int] = []
    start = 0
    for k in range(1, len(aligned) + 1):
        if k == len(aligned) or aligned[k][0] != aligned[k - 1][0] + 1 or aligned[k][1] != aligned[k - 1][1] + 1:
            run = [i for i, _ in aligned[start:k]]
            if sum(sizes[i] for i in run) >= least:
                out += run
            start = k
    return out


def _lines(batches: Iterator) -> Iterator:
    import pyarrow as pa
    import xxhash

    for batch in pieces(batches):
        hashes, sizes = [], []
        for t in batch.column(2):
            lines = [x.strip() for x in t.as_py().split("\n")]
            # a blank line is 0
            hashes.append([xxhash.xxh3_64_intdigest(x) - (1 << 63) if x else 0 for x in lines])
            sizes.append([*map(len, lines)])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))],
            ["_id", "_h", "lines", "sizes"],
        )


def _align(batches: Iterator, least: int) -> Iterator:
    import pyarrow as pa

    for batch in pieces(batches):
        out = []
        for late, sizes, early in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
            out.append(blocks(patience(late.as_py(), early.as_py()), sizes.as_py(), least))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["_id", "_h", "deleted"])


def runs(lines: list[int], sizes: list[int], least: int = LEAST_CHARS) -> list[tuple[int, int]]:
    """Shortest runs of at least `least` characters from each line on and up to each line, none across a gap; ends are included.

    Every line of a block that is not blank lies in one of the runs inside the block.
    """
    out: set[tuple[int, int]] = set()
    for step in (1, -1):
        at = range(len(lines))[::step]
        total, end = 0, 0  # of the lines at[start:end]
        for start, i in enumerate(at):
            if end < start:
                total, end = 0, start
            while end < len(at) and total < least and lines[at[end]] != GAP:
                total += sizes[at[end]]
                end += 1
            if total >= least and lines[i]:
                out.add((min(i, at[end - 1]), max(i, at[end - 1])))
            if end > start:
                total -= sizes[i]
    return sorted(out)


def outline(lines: list[int], sizes: list[int], frequent: set[int]) -> tuple[list[int], list[int], list[int]]:
    """Frequent lines, blank lines next to them and gaps, with their sizes and their places in the document."""
    near = [x in frequent for x in lines]
    for at in (range(1, len(lines)), range(len(lines) - 2, -1, -1)):
        step = at.step
        for i in at:
            near[i] = near[i] or (not lines[i] and near[i - step])
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    for i, x in enumerate(lines):
        if near[i] or not out[0] or out[0][-1] != GAP:
            for column, value in zip(out, (x, sizes[i], i) if near[i] else (GAP, 0, -1), strict=True):
                column.append(value)
    return out


def _outlines(batches: Iterator, least: int) -> Iterator:
    import numpy as np
    import pyarrow as pa
    import xxhash

    digest = lambda x: xxhash.xxh3_64_intdigest(np.array(x, np.int64).tobytes()) - (1 << 63)
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    for batch in pieces(batches):
        out: list[list] = [[], [], [], [], [], []]
        for lines, sizes, frequent, deleted in zip(*(batch.column(k) for k in range(2, 6)), strict=True):
            brief, long, places = outline(lines.as_py(), sizes.as_py(), set(frequent.as_py()))
            gone = set(deleted.as_py() or ())
            held, open_ = set(), set()
            for a, b in runs(brief, long, least):
                key = digest(brief[a : b + 1])
                held.add(key)
                # blank lines beside a run may belong to its block
                while a and brief[a - 1] == 0:
                    a -= 1
                while b + 1 < len(brief) and brief[b + 1] == 0:
                    b += 1
                if any(i not in gone for i in places[a : b + 1]):
                    open_.add(key)
            for x, y in zip(out, (digest(brief), brief, long, places, sorted(held), sorted(open_)), strict=True):
                x.append(y)
        kinds = (pa.int64(), longs, ints, ints, longs, longs)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))],
            ["_id", "_h", "key", "brief", "sizes", "places", "held", "open"],
        )


def _align_outlines(batches: Iterator, least: int) -> Iterator:
    import pyarrow as pa

    for batch in pieces(batches):
        out = []
        for late, sizes, early in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
            # gaps are never equal
            other = [GAP + 1 if x == GAP else x for x in early.as_py()]
            out.append(blocks(patience(late.as_py(), other), sizes.as_py(), least))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["late_key", "early_key", "found"])


def _by_outlines(table: DataFrame, many: DataFrame, pairs: DataFrame, cut: DataFrame, least: int) -> DataFrame:
    """`_id, _h, deleted`: what documents lose to those with which they share frequent lines only, beyond `cut`."""
    frequent = many.groupBy("d").agg(F.collect_list("line").alias("frequent")).select("d._id", "d._h", "frequent")
    rows = table.join(frequent, ["_id", "_h"]).join(cut, ["_id", "_h"], "left").select("_id", "_h", "lines", "sizes", "frequent", "deleted")
    kinds = "_id long, _h long, key long, brief array<long>, sizes array<int>, places array<int>, held array<long>, open array<long>"
    rows = written(map_arrow(rows, partial(_outlines, least=least), kinds).where("size(held) > 0"), "lines-outlines")
    doc = F.struct("_id", "_h")
    firsts = rows.groupBy("key").agg(F.min(doc).alias("e"))
    first = written(rows.withColumn("e", doc).join(firsts, ["key", "e"]).select("key", "e", "brief", "sizes", "held"), "lines-outline-firsts")
    early = first.select(F.col("key").alias("early_key"), "e", F.explode("held").alias("run"))
    late = rows.select(F.col("key").alias("late_key"), doc.alias("d"), F.explode("open").alias("run")).groupBy("late_key", "run").agg(F.max("d").alias("top"))
    both = late.join(early, "run").where("e < top").select("late_key", "early_key").distinct()
    both = both.join(first.select(F.col("key").alias("late_key"), F.col("brief").alias("a"), "sizes"), "late_key")
    both = both.join(first.select(F.col("key").alias("early_key"), F.col("brief").alias("b")), "early_key").select("late_key", "early_key", "a", "sizes", "b")
    hits = map_arrow(both, partial(_align_outlines, least=least), "late_key long, early_key long, found array<int>").where("size(found) > 0")
    hits = written(hits.join(firsts.withColumnRenamed("key", "early_key"), "early_key"), "lines-outline-hits")
    # The earliest document whose outline settles a line will do, unless it shares a rare line with the later one.
    least_e = hits.select("late_key", "e", F.explode("found").alias("at")).groupBy("late_key", "at").agg(F.min("e").alias("e"))
    least_e = least_e.groupBy("late_key", "e").agg(F.collect_list("at").alias("found"))
    docs = rows.where("size(open) > 0").select(doc.alias("d"), F.col("key").alias("late_key"), "places")
    rare = pairs.where("rare").select(F.col("late").alias("d"), F.col("early").alias("e"))
    tried = docs.join(least_e, "late_key").where("e < d").join(rare.withColumn("aligned", F.lit(True)), ["d", "e"], "left")
    tried = written(tried.select("d", "late_key", "places", "found", "aligned"), "lines-outline-tried")
    # Those look for any other document of each outline that settles lines.
    again = tried.where("aligned").select("d", "late_key", "places").dropDuplicates(["d"])
    others = again.join(hits.select("late_key", "early_key", "found"), "late_key")
    others = others.join(rows.select(F.col("key").alias("early_key"), doc.alias("e")), "early_key").where("e < d").join(rare, ["d", "e"], "left_anti")
    found = tried.where("aligned IS NULL").select("d", "places", "found").union(others.select("d", "places", "found"))
    return found.select("d._id", "d._h", F.transform("found", lambda i: F.get("places", i)).alias("deleted"))


def _merged(cut: DataFrame) -> DataFrame:
    return cut.select("_id", "_h", F.explode("deleted").alias("l")).groupBy("_id", "_h").agg(F.array_sort(F.collect_set("l")).alias("deleted"))


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, least: int = LEAST_CHARS
) -> DataFrame:
    """One row per input row: `doc_id, text, n_lines, deleted` - what is left of the text, and the deleted line numbers from 0.

    Lines end at "\\n" and are compared without white space at their ends. Of two documents the one with the larger id is
    the later, of equal ids that with the larger text hash; rows without id come first. Rows that repeat an id and its
    text are one document and get the same result. Null texts count as empty; blank lines are deleted only inside a
    block. An empty table gives an empty result; other columns are ignored.
    """
    texts = docs.select(*row_key(id_col, text_col), text_of(text_col).alias("text"))
    table = written(
        map_arrow(texts, _lines, "_id long, _h long, lines array<long>, sizes array<int>").dropDuplicates(["_id", "_h"]), "lines"
    )
    doc = F.struct("_id", "_h")
    held = table.select(doc.alias("d"), F.explode(F.array_distinct("lines")).alias("line")).where("line <> 0")
    counts = held.groupBy("line").agg(F.count("*").alias("df"), F.min("d").alias("first")).where("df > 1")
    held = written(with_counts(held, counts, "line", "df", "lines"), "lines-held")
    few = held.where(F.col("df") <= rare)
    pairs = few.select("line", F.col("d").alias("late")).join(few.select("line", F.col("d").alias("early")), "line").where("early < late")
    many = held.where(F.col("df") > rare)
    # An earlier holder: documents of a frequent line are dealt by hash over many windows, so no task holds all of them.
    before = many.withColumn("range", F.pmod(F.xxhash64("d"), F.greatest(F.col("df") / 1000, F.lit(1)).cast("long")))
    last = F.lag("d").over(Window.partitionBy("line", "range").orderBy("d"))
    hot = before.select("first", F.col("d").alias("late"), last.alias("before"))
    hot = hot.select("late", F.explode(F.array_distinct(F.array("first", F.coalesce("before", "first")))).alias("early")).where("early < late")
    pairs = pairs.select("late", "early", F.lit(True).alias("rare")).union(hot.select("late", "early", F.lit(False)))
    pairs = written(pairs.groupBy("late", "early").agg(F.max("rare").alias("rare")), "lines-pairs")
    late = table.select(doc.alias("late"), F.col("lines").alias("a"), "sizes")
    early = table.select(doc.alias("early"), F.col("lines").alias("b"))
    both = pairs.join(late, "late").join(early, "early").select("late._id", "late._h", "a", "sizes", "b")
    cut = map_arrow(both, partial(_align, least=least), "_id long, _h long, deleted array<int>").where("size(deleted) > 0")
    cut = written(_merged(cut), "lines-cut")
    cut = _merged(cut.union(_by_outlines(table, many, pairs, cut, least)))
    lines = F.split("text", "\n")
    # slices between deleted lines; transform() over one element binds the lines, so that they are split once
    cut_out = lambda of: F.zip_with(F.concat(F.array(F.lit(-1)), "deleted"), F.concat("deleted", F.array(F.size(of))), lambda a, b: F.slice(of, a + 2, b - a - 1))
    kept = F.when(F.col("deleted").isNull(), F.col("text")).otherwise(F.transform(F.array(lines), lambda of: F.array_join(F.flatten(cut_out(of)), "\n"))[0])
    return texts.join(cut, ["_id", "_h"], "left").select(
        id_back().alias("doc_id"), kept.alias("text"), F.size(lines).alias("n_lines"),
        F.coalesce("deleted", F.array().cast("array<int>")).alias("deleted"),
    )
