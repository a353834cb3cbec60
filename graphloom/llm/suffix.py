"""Removal of repeated byte strings with a distributed, sampled suffix array.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. Sorting every suffix of the corpus would
move each byte hundreds of times, so the array is sparse: of any LENGTH consecutive bytes, the one position with the
least hash of its CORE bytes is an anchor. Equal strings have their anchor at the same place, and so a repeated string
shows as two suffixes that begin at anchors with equal cores. Suffixes whose core occurs once cannot match and are left
out by counting core hashes.

The other suffixes are range-partitioned by their leading 8-byte token, at splitters sampled from them (with equal tokens
always on one side, so that no match crosses a boundary; a range is split further by core to bound what a task holds).
Each bucket is sorted by multikey quicksort, once by the bytes from the anchor on and once by those before it, backwards.
Common prefixes of neighbours then give, for every offset of a LENGTH-byte string around an anchor, the class of its part
on either side; strings equal on both sides are repeats. All comparisons are of bytes: hashes only choose candidates.

A core with more than `hot` suffixes is split by more bytes on either side until every part is small enough to be sorted. Of
the offsets a..b of strings around an anchor, all strings hold the a bytes before it and the LENGTH - b bytes from it on, so
suffixes that differ there can be sorted apart; where too many agree, the offsets are halved, which adds bytes to the key.
Suffixes that agree in all bytes of all strings concerned are repeats of each other and go on as one; a single offset has
nothing else. Inside a document that repeats itself with a short period, repeats are found by the map task, by sorting the
strings of a stretch by doubled prefixes, and only first occurrences go on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.storage import discard, written

from .common import id_back, map_arrow, pieces, row_key, text_of, with_counts

LENGTH = 200
CORE = 40
LEFT = LENGTH - CORE
#: Suffixes that a bucket holds about, and those of one key beyond which it is split by more bytes.
BUCKET = 5_000
HOT = 10_000
RANGES = 256
#: One anchor of so many carries its leading token into the sample for the splitters.
SAMPLE = 64
#: Bits of a position in a packed key; longer documents are cut into overlapping stretches.
BITS = 28
STRETCH = 1 << 24
#: Hot cores (8 bytes each) up to which texts are read again for them; beyond, texts are shuffled to their suffixes.
BROADCAST_CORES = 500_000
#: Surroundings of up to 360 bytes that are broadcast at most.
BROADCAST_SAME = 20_000
#: Strings of a document with a short period that are told apart at a time.
PIECE = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


class Powers:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 1 << 14)
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_POWERS = Powers(_BASE)


def rolled(data: np.ndarray, size: int) -> np.ndarray:
    """Mixed hashes of all strings of `size` bytes."""
    n = len(data)
    up, down = _POWERS.upto(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + _U(1)) * up[:n], out=total[1:])
    h = (total[size:] - total[: n - size + 1]) * down[: n - size + 1]
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    return h


def anchor_of_each(h: np.ndarray, width: int) -> np.ndarray:
    """For each stretch of `width` hashes the position of its least one, the first of equal ones."""
    key = ((h >> _U(BITS)) << _U(BITS)) | np.arange(len(h), dtype=np.uint64)
    have = 1
    while have * 2 <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if have < width:
        key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
    return (key & _U((1 << BITS) - 1)).astype(np.int64)


def string_classes(data: np.ndarray, size: int = LENGTH) -> np.ndarray:
    """A number for each string of `size` bytes, the same for equal bytes: classes of 8 bytes are paired until they cover it."""
    n = len(data)
    token = np.zeros(n - 7, np.uint64)
    for k in range(8):
        token = token << _U(8) | data[k : n - 7 + k].astype(np.uint64)
    have, (known, classes) = 8, np.unique(token, return_inverse=True)
    while have < size:
        step = min(have, size - have)
        pair = classes[: len(classes) - step] * len(known) + classes[step:]
        known, classes = np.unique(pair, return_inverse=True)
        have += step
    return classes


def anchors(data: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Anchors, the hashes of their cores, and stretches that are repeats within this document."""
    h = rolled(data, CORE)
    of = anchor_of_each(h, LEFT + 1)
    at = of[np.concatenate(([True], of[1:] != of[:-1]))]
    spans: list[tuple[int, int]] = []
    if len(at) * 16 > len(of):
        # A short period: strings that come again in this piece are settled here; the first of each stands for all.
        firsts = []
        for from_ in range(0, len(of), piece):
            classes = string_classes(data[from_ : from_ + piece + LENGTH - 1])
            _, first, back, count = np.unique(classes, return_index=True, return_inverse=True, return_counts=True)
            firsts.append(first + from_)
            again = np.flatnonzero(count[back] > 1) + from_
            if len(again):
                cut = np.flatnonzero(np.diff(again) > LENGTH)
                starts, ends = again[np.concatenate(([0], cut + 1))], again[np.concatenate((cut, [len(again) - 1]))]
                spans += [(int(a), int(b) + LENGTH) for a, b in zip(starts, ends, strict=True)]
        at = np.unique(of[np.concatenate(firsts)])
    return at, h[at], spans


def leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position as longs that compare as the bytes do; all positions have CORE bytes."""
    token = np.ascontiguousarray(data[at[:, None] + np.arange(8)]).view(">u8").ravel()
    return (token.astype(np.uint64) ^ _U(1 << 63)).view(np.int64)


def _anchors(batches: Iterator, stretch: int = STRETCH) -> Iterator:
    import pyarrow as pa

    names = ["_id", "_h", "core", "pos", "end", "lead"]
    for batch in pieces(batches):
        rows: list[list[np.ndarray]] = [[], [], [], []]
        which, local = [], []
        for k, t in enumerate(batch.column(2)):
            whole = np.frombuffer(t.as_buffer(), np.uint8)
            own: list[tuple] = []
            for from_ in range(0, max(len(whole) - LENGTH + 1, 0), stretch):
                data = whole[from_ : from_ + stretch + LENGTH - 1]
                at, core, spans = anchors(data)
                own.append((core.view(np.int64), at + from_, leading(data, at), (core & _U(SAMPLE - 1)) == 0))
                local += [(k, a + from_, b + from_) for a, b in spans]
            if own:
                columns = [np.concatenate(x) for x in zip(*own, strict=True)]
                # neighbouring stretches mostly have an anchor in common
                _, once = np.unique(columns[1], return_index=True)
                for x, y in zip(rows, columns, strict=True):
                    x.append(y[once])
                which.append(np.full(len(once), k))
        if which:
            row = np.concatenate(which)
            core, pos, lead, sampled = (np.concatenate(x) for x in rows)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(core), pa.array(pos),
                pa.nulls(len(row), pa.int64()), pa.array(lead, mask=~sampled),
            ], names)
        if local:
            row = pa.array([x[0] for x in local])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(row), batch.column(1).take(row), pa.nulls(len(local), pa.int64()), pa.array([x[1] for x in local], pa.int64()),
                pa.array([x[2] for x in local], pa.int64()), pa.nulls(len(local), pa.int64()),
            ], names)


def _around(batches: Iterator, splitters: np.ndarray, parts: np.ndarray) -> Iterator:
    """A row for each suffix: its bucket and the bytes around its anchor, filled up with zeros beyond the document.

    Range r of the leading tokens has parts[r] buckets.
    """
    import pyarrow as pa

    span = np.arange(-LEFT, LENGTH)
    base = np.concatenate(([0], np.cumsum(parts)))
    for batch in pieces(batches):
        for k in range(batch.num_rows):
            data = np.frombuffer(batch.column(2)[k].as_buffer(), np.uint8)
            found = batch.column(3)[k].values
            pos, core = found.field("pos").to_numpy(), found.field("core").to_numpy()
            for a in range(0, len(pos), 8192):
                at, c = pos[a : a + 8192], core[a : a + 8192]
                index = at[:, None] + span
                inside = (index >= 0) & (index < len(data))
                around = np.where(inside, data[np.clip(index, 0, len(data) - 1)], 0).astype(np.uint8)
                r = np.searchsorted(splitters, leading(data, at), side="right")
                bucket = base[r] + c % parts[r]
                n = len(at)
                offsets = pa.py_buffer((np.arange(n + 1, dtype=np.int32) * (LEFT + LENGTH)).tobytes())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, batch.column(0)[k].as_py())), pa.array(np.full(n, batch.column(1)[k].as_py())), pa.array(bucket),
                    pa.array(c), pa.array(at), pa.array(np.minimum(at, LEFT).astype(np.int32)),
                    pa.array(np.minimum(len(data) - at, LENGTH).astype(np.int32)),
                    pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(around.tobytes())]),
                ], ["_id", "_h", "bucket", "core", "pos", "before", "after", "around"])


def _around_cores(batches: Iterator, cores, stretch: int) -> Iterator:
    """What `_around` makes of the suffixes with one of the sorted `cores`, found in the texts anew."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("pos", pa.int64()), ("core", pa.int64())]))
    wanted = cores.value
    for batch in pieces(batches):
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            for found in _anchors([row], stretch):
                if found.column(2).null_count:
                    continue  # repeats that the map task has settled
                core, pos = found.column(2).to_numpy(), found.column(3).to_numpy()
                at = np.minimum(np.searchsorted(wanted, core), len(wanted) - 1)
                hit = wanted[at] == core
                if hit.any():
                    places = pa.StructArray.from_arrays([pa.array(pos[hit]), pa.array(core[hit])], ["pos", "core"])
                    listed = pa.ListArray.from_arrays(pa.array([0, len(places)], pa.int32()), places).cast(kind)
                    given = pa.RecordBatch.from_arrays([*row.columns[:3], listed], ["_id", "_h", "text", "places"])
                    yield from _around([given], np.zeros(0, np.int64), np.ones(1, np.int64))


def multikey_quicksort(rows: np.ndarray) -> np.ndarray:
    """Order of the byte strings in `rows`, all of one length that is a multiple of 8.

    Breadth first: at each depth the strings that are still tied are quicksorted by their group and their token of 8
    bytes at that depth, and those with a token of their own drop out.
    """
    tokens = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.arange(len(rows))
    open_ = np.arange(len(rows))  # places in `order` that are not settled
    group = np.zeros(len(rows), np.int64)
    for depth in range(tokens.shape[1]):
        if not len(open_):
            break
        token = tokens[order[open_], depth]
        by = np.argsort(token, kind="quicksort")
        by = by[np.argsort(group[by], kind="stable")]
        order[open_] = order[open_][by]
        token, group = token[by], group[by]
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (group[1:] != group[:-1])))
        group = np.cumsum(new)
        tied = np.bincount(group)[group] > 1
        open_, group = open_[tied], group[tied]
    return order


def common_prefix(rows: np.ndarray) -> np.ndarray:
    """Of each row with the one before: how many leading bytes are equal; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    for a in range(1, len(rows), 1 << 15):
        x, y = rows[a : a + (1 << 15)], rows[a - 1 : a - 1 + len(rows[a : a + (1 << 15)])]
        differ = x != y
        out[a : a + len(x)] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def repeated(around: np.ndarray, before: np.ndarray, after: np.ndarray, lo: int = 0, hi: int = LEFT) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the least and the largest offset, of those from `lo` to `hi`, of its anchor in a repeated string; -1 where there is none."""
    n = len(around)
    left, right = around[:, :LEFT][:, ::-1], around[:, LEFT:]
    classes = []
    for part in (left, right):
        order = multikey_quicksort(part)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        classes.append((place, common_prefix(part[order])))
    (lp, lc), (rp, rc) = classes
    least, most = np.full(n, -1), np.full(n, -1)
    for offset in range(lo, hi + 1):
        ok = np.flatnonzero((before >= offset) & (after >= LENGTH - offset))
        if len(ok) < 2:
            continue
        key = np.cumsum(lc < offset)[lp[ok]] * (n + 1) + np.cumsum(rc < LENGTH - offset)[rp[ok]]
        by = np.argsort(key, kind="quicksort")
        same = key[by[1:]] == key[by[:-1]]
        hit = np.zeros(len(ok), bool)
        hit[by[1:][same]] = True
        hit[by[:-1][same]] = True
        found = ok[hit]
        most[found] = offset
        least[found[least[found] < 0]] = offset
    return least, most


def _sorted_bucket(table):
    import pyarrow as pa

    core = table["core"].to_numpy()
    _, back, count = np.unique(core, return_inverse=True, return_counts=True)
    stay = np.flatnonzero(count[back] > 1)
    table = table.take(pa.array(stay))
    column = table["around"].combine_chunks()
    around = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, LEFT + LENGTH)
    least, most = repeated(around, table["before"].to_numpy(), table["after"].to_numpy())
    hit = np.flatnonzero(most >= 0)
    pos = table["pos"].to_numpy()[hit]
    keys = table.select(["_id", "_h"]).take(pa.array(hit))
    return pa.table({"_id": keys["_id"], "_h": keys["_h"], "start": pos - most[hit], "end": pos - least[hit] + LENGTH})


def _sorted_part(table):
    """Spans of the suffixes of one bucket of a split core; those that stand for several are told already."""
    import pyarrow as pa

    lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
    wide = np.frombuffer(b"".join(table["wide"].combine_chunks().to_pylist()), np.uint8).reshape(table.num_rows, -1)
    around = np.zeros((len(wide), LEFT + LENGTH), np.uint8)
    around[:, LEFT - hi : LEFT + LENGTH - lo] = wide
    least, most = repeated(around, table["left"].to_numpy(), table["right"].to_numpy(), lo, hi)
    hit = np.flatnonzero((most >= 0) & (table["n"].to_numpy() == 1))
    pos = table["pos"].to_numpy()[hit]
    keys = table.select(["_id", "_h"]).take(pa.array(hit))
    return pa.table({"_id": keys["_id"], "_h": keys["_h"], "start": pos - most[hit], "end": pos - least[hit] + LENGTH})


def _hot_spans(rows: DataFrame, hot: int, bucket: int) -> DataFrame:
    """Spans of the suffixes `rows(_id, _h, pos, before, after, around)` of cores with more than `hot` of them.

    A level halves the offsets lo..hi of what is still too hot; 9 levels come to single offsets. `wide` holds the bytes of
    all strings at those offsets, `left` and `right` how many of them lie in the document on either side of the anchor.
    """
    spans = "_id long, _h long, start long, end long"
    out = rows.sparkSession.createDataFrame([], spans)
    key = ["lo", "hi", "wide", "left", "right"]
    now = rows.select(
        "_id", "_h", "pos", F.lit(0).alias("lo"), F.lit(LEFT).alias("hi"), F.col("around").alias("wide"), F.col("before").alias("left"),
        F.col("after").alias("right"), F.lit(1).cast("long").alias("n"),
    )
    while True:
        now = written(now.where(f"{LENGTH} - right <= left"), "suffix-hot")
        # Numbers only, so sums are hashed and partial; a group of one keeps its own.
        same = written(now.groupBy(*key).agg(F.sum("n").alias("n"), *[F.max(c).alias(c) for c in ("_id", "_h", "pos")]), "suffix-same")
        # All strings of suffixes that agree throughout are repeats.
        alike = same.where("n > 1").select(*key)
        alike = F.broadcast(alike) if alike.count() <= BROADCAST_SAME else alike
        told = now.where("n = 1").join(alike, key).select("_id", "_h", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("right")).alias("end"))
        out = out.unionByName(written(told, "suffix-told"))
        # Only those that agree in the bytes that all strings hold can have strings in common.
        part = ["lo", "hi", "narrow"]
        one = same.withColumn("narrow", F.xxhash64(F.expr(f"substring(wide, hi - lo + 1, lo + {LENGTH} - hi)")))
        counts = one.groupBy(*part).agg(F.count("*").alias("c")).where("c > 1")
        one = written(one.join(counts, part), "suffix-parts")
        discard(now, same)
        few = one.where(F.col("c") <= hot)
        slots = max(1, -(-few.count() // bucket))
        few = few.withColumn("slot", F.pmod(F.col("narrow"), F.lit(slots))).drop("narrow", "c")
        out = out.unionByName(written(few.groupBy("lo", "hi", "slot").applyInArrow(_sorted_part, spans), "suffix-sorted"))
        many = one.where(F.col("c") > hot)
        if not many.limit(1).count():
            return out
        half = F.expr("(lo + hi) DIV 2").cast("int")
        halves = F.explode(F.array(F.struct(F.col("lo").alias("a"), half.alias("b")), F.struct((half + 1).alias("a"), F.col("hi").alias("b"))))
        now = many.withColumn("x", halves).select(
            "_id", "_h", "pos", F.col("x.a").alias("lo"), F.col("x.b").alias("hi"), F.expr(f"substring(wide, hi - x.b + 1, x.b + {LENGTH} - x.a)").alias("wide"),
            F.expr("least(left, x.b)").alias("left"), F.expr(f"least(right, {LENGTH} - x.a)").alias("right"), "n",
        )


def _cut(batches: Iterator) -> Iterator:
    import pyarrow as pa

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in pieces(batches):
        kept, size, spans = [], [], []
        for t, found in zip(batch.column(1), batch.column(2), strict=True):
            data = t.as_buffer().to_pybytes()
            merged: list[list[int]] = []
            for a, b in sorted((x["start"], x["end"]) for x in found.as_py() or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            at, parts = 0, []
            for a, b in merged:
                parts.append(data[at:a])
                at = b
            kept.append(b"".join(parts) + data[at:] if parts else data)
            size.append(len(data))
            spans.append([{"start": a, "end": b} for a, b in merged])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["_id", "n_bytes", "spans", "kept"])


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, hot: int = HOT, stretch: int = STRETCH
) -> DataFrame:
    """One row per input row: `doc_id, n_bytes, spans, kept` - maximal removed runs (bytes, end exclusive) and the rest.

    Repeats are judged on the input, within a document too, never across its end. Null texts count as empty; texts
    under 200 bytes lose nothing. Null ids are kept. Rows that repeat an id and its text are copies like any others,
    so all their strings go. An empty table gives an empty result; other columns are ignored.
    """
    texts = docs.select(*row_key(id_col, text_col), F.encode(text_of(text_col), "UTF-8").alias("text"))
    found = written(
        map_arrow(texts, partial(_anchors, stretch=stretch), "_id long, _h long, core long, pos long, end long, lead long"), "suffix-anchors"
    )
    local = found.where("core IS NULL").select("_id", "_h", F.col("pos").alias("start"), "end")
    sparse = found.where("core IS NOT NULL").select("_id", "_h", "core", "pos", "lead")
    counts = sparse.groupBy("core").agg(F.count("*").alias("c")).where("c > 1")
    open_ = written(with_counts(sparse, counts, "core", "c", "suffix"), "suffix-candidates")
    n = open_.count()
    # At most RANGES - 1 numbers come to the driver.
    ranges = max(1, min(RANGES, n // bucket))
    at = open_.where("lead IS NOT NULL").agg(F.percentile_approx("lead", [k / ranges for k in range(1, ranges)] or [0.5], 4096)).first()[0]
    quantiles = np.array(at if at and ranges > 1 else [], np.int64)
    splitters, first = np.unique(quantiles, return_index=True)
    # A token that is many quantiles makes a large range, which gets as many more buckets.
    share = np.diff(np.concatenate(([0], first + 1, [len(quantiles) + 1])))
    parts = np.maximum(1, -(-share * n // ((len(quantiles) + 1) * bucket))).astype(np.int64)

    def around(rows: DataFrame) -> DataFrame:
        places = rows.groupBy("_id", "_h").agg(F.collect_list(F.struct("pos", "core")).alias("places"))
        return map_arrow(
            texts.join(places, ["_id", "_h"]).select("_id", "_h", "text", "places"), partial(_around, splitters=splitters, parts=parts),
            "_id long, _h long, bucket long, core long, pos long, before int, after int, around binary",
        )

    spans = around(open_.where(F.col("c") <= hot)).groupBy("bucket").applyInArrow(_sorted_bucket, "_id long, _h long, start long, end long")
    spans = spans.unionByName(local)
    cores = written(open_.where(F.col("c") > hot).select("core").distinct(), "suffix-hot-cores")
    if many := cores.count():
        if many <= BROADCAST_CORES:
            found_again = np.sort(cores.toArrow()["core"].to_numpy())
            shared = docs.sparkSession.sparkContext.broadcast(found_again)
            rows = map_arrow(
                texts, partial(_around_cores, cores=shared, stretch=stretch),
                "_id long, _h long, bucket long, core long, pos long, before int, after int, around binary",
            )
        else:
            rows = around(open_.where(F.col("c") > hot))
        spans = spans.unionByName(_hot_spans(rows, hot, bucket))
    gone = spans.groupBy("_id", "_h").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    out = map_arrow(
        texts.join(gone, ["_id", "_h"], "left").select("_id", "text", "found"), _cut,
        "_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary",
    )
    return out.select(id_back().alias("doc_id"), "n_bytes", "spans", "kept")
