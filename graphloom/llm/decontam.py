"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations only.

A document matches an item of n shingles if the weighted Jaccard similarity of some window of n shingles with the item is
SHARE hundredths or more. Such a window holds at least 3 (v + n) / 7 occurrences of the item's shingles, v being its size
(n, or all of a shorter document), and none that does so is passed over:

* A window's part outside the benchmark adds nothing to a common part, so a window stands for its benchmark shingles and
  its size. Of windows with the same first benchmark shingle the last one holds all that the others hold; so windows
  start at benchmark shingles (or end with the document). Those with too few shingles of items of their size are dropped.
* Windows with the same benchmark shingles are one set, whatever documents they come from; a shingle's second occurrence is
  a feature of its own, so that weighted similarity is that of plain sets.
* Each set, and each item, gets a SimHash of LONGS x 63 bits, cut into BLOCKS blocks of 10 or 11 bits. Joining on blocks
  finds, whatever the bits, all pairs that differ in fewer than BLOCKS bits; a pair at the least similarity differs in
  62 of 504 bits on the mean and is missed with probability 1e-6 (where all other shingles of the window belong to other
  items of the same length, 1e-3). Two sets that have nothing in common meet in 3 % of cases.
* What the fingerprints miss is found by the sets themselves: with features ordered by the number of items that hold them, two sets with
  t features in common share one of the first a - t + 1 of either (a being its size). So no pair is left to chance.
* Pairs within RADIUS bits, and those that share such a rare feature, are measured exactly.
* Items of COARSE shingles and more take windows in steps of n / COARSE, of which the nearest to a match falls short by less than a step;
  what comes near is then measured at every start, by running sums over the item's shingles in the document. So no row
  holds more than about COARSE / 7 windows, and of such an item the best window of a document is told.

Texts are read once and never shuffled. The benchmark's shingles are broadcast up to a counted size, beyond which the same
join shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_back, row_key, text_of, written

SHINGLE = 5
#: Least similarity, in hundredths.
SHARE = 75
#: Fingerprints are so many longs, of which 63 bits are used: 21 sums of three lanes, for up to 2 ** 21 shingles.
LONGS = 8
LANE = 21
CUTS = (0, 10, 21, 31, 42, 52, 63)
BLOCKS = LONGS * (len(CUTS) - 1)
#: Bits in which fingerprints may differ: 62 expected at the least similarity (87 at the worst), with deviation 7.5 (8.5).
RADIUS = 130
#: Shingles of a stretch of a document that is searched for windows at a time, beside the last window's.
STRETCH = 4096
#: Items of so many shingles take windows in steps.
COARSE = 512
#: Rows of 16 bytes (a shingle, a block, or of features) up to which a side of the benchmark is broadcast.
BROADCAST_SHINGLES = 1_000_000
BROADCAST_IDS = 500_000


def shingle_hashes(text: Column) -> Column:
    """Hashes of the five-word shingles at every word; of all words where they are fewer; none without words."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    # transform() over one element binds the hashed words, so that they are computed once
    return F.transform(
        F.array(hashed),
        lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - (SHINGLE - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, SHINGLE)))
        ),
    )[0]


#: Occurrences of an item's shingles that a window of `v` shingles needs: c / (v + n - c) >= 0.75.
NEEDED = f"CAST(({SHARE} * (v + n) + {99 + SHARE}) DIV {100 + SHARE} AS INT)"

#: A step of windows, and how many of a window's shingles its neighbours within the step may lack.
STEP = f"CAST(1 + n DIV {COARSE} AS INT)"
NEAR = f"greatest(1, {NEEDED} - {STEP} + 1)"

#: Of the sorted `hits` (place p, shingle s) of a stretch, those that a window starts at: the first of each step. The last window of a document starts before its first hit.
STARTS = f"""
filter(sequence(0, size(hits) - 1), k -> get(hits, k).p DIV stretch = part
  AND get(hits, k + {NEAR} - 1).p < least(get(hits, k).p, w - v) + v
  AND (get(hits, k).p <= w - v OR k = 0 OR get(hits, k - 1).p < w - v)
  AND (k = 0 OR get(hits, k).p DIV {STEP} <> get(hits, k - 1).p DIV {STEP} OR get(hits, k - 1).p < w - v AND get(hits, k).p >= w - v))
"""

#: The same of an item, for the least `v` of a window that can match it: three quarters of its size.
NEAR_LEAST = f"greatest(1, CAST(({SHARE} * n + 99) DIV 100 AS INT) - {STEP} + 1)"

#: Those hits' windows: start and sorted shingles.
WINDOWS = f"""
transform({STARTS}, k -> named_struct('start', least(get(hits, k).p, w - v),
  'ws', array_sort(transform(filter(slice(hits, k + 1, v), x -> x.p < least(get(hits, k).p, w - v) + v), x -> x.s))))
"""

#: The sorted array `ws` with the second and later occurrences of a shingle made features of their own.
FEATURES = "transform(ws, (h, i) -> CASE WHEN i = 0 OR get(ws, i - 1) <> h THEN h ELSE xxhash64(h, i + 1 - array_position(ws, h)) END)"


def _with_key(df: DataFrame) -> DataFrame:
    return df.withColumns({f"k{x}": F.xxhash64(F.lit(x), "n", "v", "ws") for x in (1, 2)})


def fingerprints(sets: DataFrame) -> DataFrame:
    """`k1, k2, fp` (an array of LONGS longs) of `sets(k1, k2, features)`: a bit is set where most features' hashes have it.

    Sums of three bits each in lanes of a long are combined before the shuffle.
    """
    lanes = sum(1 << LANE * x for x in range(3))
    each = sets.select("k1", "k2", F.explode("features").alias("f")).select("k1", "k2", "f", F.explode(F.array(*map(F.lit, range(LONGS)))).alias("j"))
    each = each.withColumn("h", F.xxhash64("f", "j"))
    sums = each.groupBy("k1", "k2", "j").agg(F.count("*").alias("c"), *[F.sum(F.expr(f"shiftright(h, {k}) & {lanes}L")).alias(f"s{k}") for k in range(LANE)])
    bits = [f"CASE WHEN 2 * (shiftright(s{k}, {LANE * x}) & {(1 << LANE) - 1}L) > c THEN {1 << k + LANE * x}L ELSE 0L END" for k in range(LANE) for x in range(3)]
    told = sums.select("k1", "k2", F.struct("j", F.expr(" | ".join(bits)).alias("bits")).alias("x"))
    return told.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("x")).alias("x")).select("k1", "k2", F.col("x.bits").alias("fp"))


def blocks() -> Column:
    """The blocks of `fp`, each with its number."""
    per = len(CUTS) - 1
    return F.array(*[
        F.struct(F.lit(per * j + i).alias("block"), F.expr(f"shiftright(fp[{j}], {a}) & {(1 << b - a) - 1}L").alias("bits"))
        for j in range(LONGS) for i, (a, b) in enumerate(zip(CUTS, CUTS[1:], strict=False))
    ])


def rarest(sets: DataFrame, features: str, counts: DataFrame, least: str) -> DataFrame:
    """`sets` with each of its first features `f` by `counts(n, f, c)`, in as many rows: of two sets with `least` in common one is in both.

    Features that no item of the length holds are in no common part, and sets with less than `least` others are left out.
    """
    keys = [c for c in sets.columns if c != features]
    each = sets.select(*keys, F.explode(features).alias("f")).join(counts, ["n", "f"])
    ranked = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("c", "f"))).alias("fs"))
    return ranked.where(f"size(fs) >= {least}").select(*keys, F.explode(F.expr(f"slice(fs, 1, size(fs) - {least} + 1)")).alias("x")).select(*keys, "x.f")


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(_id, _h, item_id, start, similarity)`: windows found and the items they match; start counts shingles from 0.

    Of windows that differ only in shingles outside the benchmark the last is told.
    """
    items = benchmark.where("item_id IS NOT NULL").select("item_id", F.array_sort(shingle_hashes(text_of())).alias("ws")).where("size(ws) > 0")
    items = written(_with_key(items.withColumn("n", F.size("ws")).withColumn("v", F.col("n"))), "decontam-items")
    known = written(items.select("n", F.explode("ws").alias("s")).distinct(), "decontam-shingles")
    n_items, n_shingles = items.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    def near(df: DataFrame, rows: int) -> DataFrame:
        """Broadcast if it has no more than so many rows of a shingle's size."""
        return F.broadcast(df) if rows <= BROADCAST_SHINGLES else df

    all_ws = docs.select(*row_key(id_col, text_col), shingle_hashes(text_of(text_col)).alias("all_ws"))
    places = all_ws.select("_id", "_h", F.size("all_ws").alias("w"), F.posexplode("all_ws").alias("p", "s"))
    hits = places.join(near(known, known.count()), "s").withColumn("stretch", F.expr(f"greatest({STRETCH}, 4 * n)"))
    # the first hits of a stretch belong to windows of the one before, too
    part = F.expr("CASE WHEN p >= stretch AND p % stretch < n THEN array(p DIV stretch, p DIV stretch - 1) ELSE array(p DIV stretch) END")
    hits = hits.select("_id", "_h", "w", "n", "stretch", "p", "s", F.explode(part).alias("part"))
    per = hits.groupBy("_id", "_h", "w", "n", "stretch", "part").agg(F.array_sort(F.collect_set(F.struct("p", "s"))).alias("hits"))
    per = per.withColumn("v", F.least("w", "n")).where(f"size(hits) >= {NEAR}")
    windows = per.select("_id", "_h", "n", "v", F.explode(F.expr(WINDOWS)).alias("x")).select("_id", "_h", "n", "v", "x.start", "x.ws")
    windows = written(_with_key(windows), "decontam-windows")
    columns = ["k1", "k2", "n", "v", "ws"]
    sets = windows.select(*columns, F.lit(False).alias("item")).union(items.select(*columns, F.lit(True)))
    sets = sets.groupBy("k1", "k2").agg(F.first("n").alias("n"), F.first("v").alias("v"), F.first("ws").alias("ws"), F.max("item").alias("item"), F.min("item").alias("only"))
    sets = written(sets.select("k1", "k2", "n", "v", F.expr(FEATURES).alias("features"), "item", (~F.col("only")).alias("window")), "decontam-sets")
    sets = written(sets.join(fingerprints(sets), ["k1", "k2"]), "decontam-fingerprints")
    ours, theirs = sets.where("window"), sets.where("item")
    theirs = theirs.select("n", F.col("k1").alias("i1"), F.col("k2").alias("i2"), "fp", F.col("features").alias("item_features"))
    met = (
        ours.select("n", "k1", "k2", F.explode(blocks()).alias("x")).select("n", "k1", "k2", "x.*")
        .join(near(theirs.select("n", "i1", "i2", F.explode(blocks()).alias("x")).select("n", "i1", "i2", "x.*"), 2 * BLOCKS * n_items), ["n", "block", "bits"])
        .select("k1", "k2", "i1", "i2").distinct()
    )
    # every pair that can match, whatever its fingerprints
    counts = theirs.select("n", F.explode("item_features").alias("f")).groupBy("n", "f").agg(F.count("*").alias("c"))
    counts = near(written(counts, "decontam-counts"), 2 * n_shingles)
    first = rarest(theirs.select("n", "i1", "i2", "item_features"), "item_features", counts, NEAR_LEAST)
    shared = rarest(ours.select("n", "v", "k1", "k2", "features"), "features", counts, NEAR).join(near(written(first, "decontam-first"), 2 * n_shingles), ["n", "f"])
    met = met.withColumn("rare", F.lit(False)).unionByName(shared.select("k1", "k2", "i1", "i2", F.lit(True).alias("rare")))
    met = met.groupBy("k1", "k2", "i1", "i2").agg(F.max("rare").alias("rare"))
    differ = F.expr("aggregate(zip_with(fp, item_fp, (x, y) -> bit_count(x ^ y)), 0, (t, x) -> t + x)")
    measured = (
        met.join(ours.select("k1", "k2", "v", "features", "fp"), ["k1", "k2"])
        .join(near(theirs.withColumnRenamed("fp", "item_fp"), n_shingles + 8 * n_items), ["i1", "i2"]).where(F.col("rare") | (differ <= RADIUS))
        .withColumn("c", F.size(F.array_intersect("features", "item_features"))).withColumn("u", F.expr("v + n - c"))
        .where(f"100 * (c + {STEP} - 1) >= {SHARE} * (v + n - (c + {STEP} - 1))").select("n", "k1", "k2", "i1", "i2", (F.col("c") / F.col("u")).alias("similarity"))
    )
    names = items.select("item_id", F.col("k1").alias("i1"), F.col("k2").alias("i2")).distinct()
    found = measured.join(near(names, n_items), ["i1", "i2"]).select("n", "k1", "k2", "i1", "i2", "item_id", "similarity")
    found = written(found, "decontam-found")
    if found.count() <= BROADCAST_IDS:
        found = F.broadcast(found)
    at = windows.select("_id", "_h", "start", "k1", "k2").join(found, ["k1", "k2"])
    told = at.where(f"n < {COARSE}").select("_id", "_h", "item_id", "start", "similarity")
    pairs = written(at.where(f"n >= {COARSE}").select("_id", "_h", "i1", "i2", "item_id").distinct(), "decontam-long")
    return told.unionByName(_measured(all_ws, items, pairs)) if pairs.limit(1).count() else told


def _measured(all_ws: DataFrame, items: DataFrame, pairs: DataFrame) -> DataFrame:
    """The best window of each document and item of `pairs(_id, _h, i1, i2, item_id)`, over all starts: of the best the last.

    An occurrence of a shingle that the item has m times adds one to the windows that hold it but not the m occurrences before
    it. So it adds to a run of starts, and sums of where runs begin and end give the common part at every start.
    """
    which = pairs.select("_id", "_h").distinct()
    texts = all_ws.join(F.broadcast(which) if which.count() <= BROADCAST_IDS else which, ["_id", "_h"], "left_semi").dropDuplicates(["_id", "_h"])
    places = texts.select("_id", "_h", F.size("all_ws").alias("w"), F.posexplode("all_ws").alias("p", "s"))
    wanted = items.select(F.col("k1").alias("i1"), F.col("k2").alias("i2"), "n", "ws").dropDuplicates(["i1", "i2"])
    wanted = wanted.join(pairs.select("i1", "i2").distinct(), ["i1", "i2"], "left_semi").select("i1", "i2", "n", F.explode("ws").alias("s")).groupBy("i1", "i2", "n", "s").agg(F.count("*").cast("int").alias("m"))
    of = pairs.select("_id", "_h", "i1", "i2").distinct()
    hits = places.join(of, ["_id", "_h"]).join(wanted, ["i1", "i2", "s"])
    key = ["_id", "_h", "i1", "i2"]
    each = hits.groupBy(*key, "n", "w", "s", "m").agg(F.array_sort(F.collect_list("p")).alias("ps")).withColumn("v", F.least("w", "n"))  # a document's occurrences
    runs = each.select(*key, "n", "v", F.explode(F.expr("transform(ps, (p, i) -> struct(greatest(0, p - v + 1, coalesce(get(ps, i - m) + 1, 0)) AS a, least(p, w - v) AS b))")).alias("r"))
    ends = runs.where("r.a <= r.b").select(*key, "n", "v", F.explode(F.expr("array(struct(r.a AS at, 1 AS d), struct(r.b + 1 AS at, -1 AS d))")).alias("e"))
    steps = ends.groupBy(*key, "n", "v", "e.at").agg(F.sum("e.d").alias("d"))
    order = Window.partitionBy(*key).orderBy("at")
    sums = steps.withColumns({"c": F.sum("d").over(order), "_to": F.lead("at").over(order) - 1})
    best = sums.groupBy(*key, "n", "v").agg(F.max(F.struct("c", "_to")).alias("x")).select(*key, "n", "v", "x.c", F.col("x._to").alias("start"))
    good = best.where(f"100 * c >= {SHARE} * (v + n - c)").withColumn("similarity", F.col("c") / (F.col("v") + F.col("n") - F.col("c")))
    return good.join(pairs, key).select("_id", "_h", "item_id", F.col("start").cast("int").alias("start"), "similarity")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `doc_id, contaminated, kept, n_items, item_ids, best_similarity`.

    Words are lower-cased and split at ASCII white space; a text of fewer than five words is one shingle of all of them,
    and matches only texts of the same words. Null, empty and blank texts, of documents or items, match nothing. Null
    ids are kept; rows that repeat get the same result; items without id are passed over, items of one id count once. An
    empty table gives an empty result, an empty benchmark leaves all clean. Other columns are ignored.
    """
    found = matches(docs, benchmark, id_col, text_col).groupBy("_id", "_h").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("best_similarity")
    )
    rows = docs.select(*row_key(id_col, text_col)).join(found, ["_id", "_h"], "left")
    return rows.select(
        id_back().alias("doc_id"),
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.col("item_ids").isNull().alias("kept"),
        F.when(F.col("item_ids").isNull(), 0).otherwise(F.size("item_ids")).alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
        F.coalesce("best_similarity", F.lit(0.0)).alias("best_similarity"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that hold no benchmark passage.

    Null, empty and blank texts hold none and stay, as do rows without id whose text holds none; rows that repeat an id are told apart by
    their texts. An empty benchmark keeps all rows, an empty table gives an empty one. Columns keep their names, whatever these are.
    """
    hit = matches(docs, benchmark, id_col, text_col).select("_id", "_h").distinct()
    hit = written(hit, "decontam-hit")
    key = row_key(id_col, text_col)
    dropped = F.broadcast(hit) if hit.count() <= BROADCAST_IDS else hit
    # a struct keeps the documents' own columns apart from the key's
    rows = docs.select(F.struct("*").alias("row"), *key)
    return rows.join(dropped, ["_id", "_h"], "left_anti").select("row.*")
