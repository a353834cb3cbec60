"""MinHash near-dedup by tensored banding, candidates verified on the full shingle sets.

Instead of T independent tables of four minhashes each, two small collections of `SIDE` pair-hashes are computed, and
every pair of one hash from either collection is a table key: SIDE ** 2 = 144 tables out of 2 * SIDE * 2 = 48 minhashes,
about the square root of what independent tables take. Documents of similarity s meet in some table with probability
(1 - (1 - s**2) ** SIDE) ** 2, which is 0.9999 at 0.75 and more above.

Groups of one table key are not expanded into all pairs. Documents of equal shingle sets are one node. In a first round
each member is compared with a few centres of its groups, chosen by hash; components of the verified links follow. Where
a member and a centre of its group ended in different components, other members of those could still link them. These
components are gathered, with the shingles of their nodes, and compared in blocks: a task counts common shingles between
the nodes of two blocks through an inverted index, and tells only which components are linked, at most one row for each.
No pair that could link is left out, no cap is needed, and no rows are made for pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, map_arrow, pieces, with_counts, written

SHINGLE = 5
SIDE = 12
#: Links need 100 * intersection >= SHARE * union.
SHARE = 75
#: Up to so many ids (8 bytes each) are broadcast to read their texts again; beyond, the texts are shuffled to them.
BROADCAST_IDS = 500_000
#: Shingles (8 bytes each) that a block holds about; a task compares two blocks.
BLOCK = 1 << 17

_RANDOM = np.random.default_rng(20240229)
_POSITION = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _RANDOM.integers(1, 1 << 63, 4 * SIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RANDOM.integers(0, 1 << 63, 4 * SIDE, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """64-bit hash of a word; bounded."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 200_000:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


def shingles(text: bytes, words: Words, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a UTF-8 text, A-Z lower-cased; of all its words if they are fewer."""
    tokens = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, tokens), np.uint64, n)
    size = min(k, n)
    h = np.full(n - size + 1, size, np.uint64) * _POSITION[63]
    for i in range(size):
        h += w[i : n - size + 1 + i] * _POSITION[i]
    return np.unique(mixed(h))


def pair_hashes(h: np.ndarray) -> np.ndarray:
    """Both collections, one after the other: 2 * SIDE hashes of two minhashes each."""
    low = np.full(4 * SIDE, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096, None]
        low = np.minimum(low, ((part ^ _FLIP) * _MULTIPLY).min(axis=0))
    return mixed(low[0::2] * np.uint64(3) + mixed(low[1::2]))


def _signatures(batches: Iterator) -> Iterator:
    import pyarrow as pa

    words = Words()
    kind = pa.list_(pa.int64())
    for batch in pieces(batches):
        n, d1, d2, a, b = [], [], [], [], []
        for t in batch.column(1):
            h = shingles(t.as_buffer().to_pybytes(), words)
            n.append(len(h))
            digest = np.frombuffer(hashlib.blake2b(h.tobytes(), digest_size=16).digest(), np.int64)
            d1.append(int(digest[0]))
            d2.append(int(digest[1]))
            p = pair_hashes(h).view(np.int64) if len(h) else np.zeros(0, np.int64)
            a.append(p[:SIDE])
            b.append(p[SIDE:])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(a, kind), pa.array(b, kind)],
            ["doc_id", "n", "d1", "d2", "a", "b"],
        )


def _sets(batches: Iterator) -> Iterator:
    import pyarrow as pa

    words = Words()
    for batch in pieces(batches):
        sets = [shingles(t.as_buffer().to_pybytes(), words).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])


def _verified(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate((a, b))
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            ok.append(100 * shared >= SHARE * (len(both) - shared))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["x", "y", "linked"])


def _links(table):
    """Of one pair of blocks: links between components that the nodes' sets show, without those that others imply."""
    import pyarrow as pa

    parts = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
    comp, side = table["comp"].to_numpy(), table["block"].to_numpy()
    low, high = table["lo"][0].as_py(), table["hi"][0].as_py()
    sizes = np.array([len(p) for p in parts])
    owner = np.repeat(np.arange(len(parts)), sizes)
    _, ids, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    ids = ids.ravel()
    order = np.argsort(ids, kind="stable")
    posting, start = owner[order], np.concatenate(([0], np.cumsum(count)))
    at = np.concatenate(([0], np.cumsum(sizes)))
    parent = {c: c for c in np.unique(comp).tolist()}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out: list[tuple[int, int]] = []
    for x in np.flatnonzero(side == low).tolist():
        own = ids[at[x] : at[x + 1]]
        own = own[count[own] > 1]
        if not len(own):
            continue
        meets = np.concatenate([posting[start[i] : start[i + 1]] for i in own.tolist()])
        shared = np.bincount(meets, minlength=len(parts))
        near = (100 * shared >= SHARE * (sizes + sizes[x] - shared)) & (side == high) & (comp != comp[x])
        for c in np.unique(comp[near]).tolist():
            a, b = root(int(comp[x])), root(c)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(comp[x]), c))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text")
    )


def _texts_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    ids = written(ids, "minhash-ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return texts.join(wanted, F.col("doc_id") == F.col("node"), "left_semi")


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """`pairs(x, y)` with `linked`, on the full sets. Rows of one id are one document; any of their sets will do."""
    ids = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct()
    # Written: both joins read them, and what many pairs have in common can be dealt anew.
    sets = written(map_arrow(_texts_of(ids, texts), _sets, "node long, shingles binary"), "minhash-sets")
    with_x = pairs.join(sets.select(F.col("node").alias("x"), F.col("shingles").alias("_x")), "x")
    with_both = with_x.join(sets.select(F.col("node").alias("y"), F.col("shingles").alias("_y")), "y")
    return map_arrow(with_both.select("x", "y", "_x", "_y"), _verified, "x long, y long, linked boolean")


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("x"), F.greatest(x, y).alias("y")]


def _across(apart: DataFrame, comp: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links `a, b` between components, where `apart(x, y)` are pairs of one table that are not linked directly."""
    of = lambda df, n: df.join(comp.select(F.col("node").alias(n), F.col("component").alias(f"c{n}")), n, "left").withColumn(f"c{n}", F.coalesce(f"c{n}", n))
    edges = of(of(apart, "x"), "y").where("cx <> cy").select(F.col("cx").alias("a"), F.col("cy").alias("b")).distinct()
    family = written(components(edges, "minhash-families").select(F.col("node").alias("comp"), F.col("component").alias("family")), "minhash-families")
    sizes = nodes.groupBy("node").agg(F.max("n").alias("n"))
    open_ = sizes.join(comp, "node", "left").select("node", "n", F.coalesce("component", "node").alias("comp")).join(family, "comp")
    # Nodes are dealt over blocks of about BLOCK shingles by hash, so no task numbers a family's nodes.
    last = open_.groupBy("family").agg(F.floor((F.sum("n") - 1) / BLOCK).alias("last"))
    open_ = open_.join(last, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("last") + 1))
    open_ = written(open_, "minhash-open")
    sets = map_arrow(_texts_of(open_.select("node"), texts), _sets, "node long, shingles binary")
    dealt = open_.join(sets, "node").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    dealt = dealt.select("family", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "comp", "shingles")
    return dealt.groupBy("family", "lo", "hi").applyInArrow(_links, "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `doc_id, n_shingles, component_id, kept`.

    component_id is the least id reachable over links, the document's own included; kept: the id is that one. Texts are
    split at ASCII white space, A-Z count as a-z; a text of fewer than five words is one shingle. Null, empty and blank
    texts have no shingle and are linked with nothing. Rows that repeat an id are one document. Rows without id are linked
    with nothing: component_id is null and kept true. An empty table gives an empty result; other columns are ignored.
    """
    texts = _texts(docs, id_col, text_col)
    signed = written(
        map_arrow(texts, _signatures, "doc_id long, n long, d1 long, d2 long, a array<long>, b array<long>"), "minhash-signatures"
    )
    nodes = written(
        signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2")
        .agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b")),
        "minhash-nodes",
    )
    # A table needs both its halves to collide: only nodes whose first half meets another go on to the second.
    halves = nodes.select("node", "n", "b", F.posexplode("a").alias("i", "ha"))
    shared = halves.groupBy("i", "ha").agg(F.count("*").alias("_c")).where("_c > 1").drop("_c")
    tables = halves.join(shared, ["i", "ha"]).select("node", "n", "i", "ha", F.posexplode("b").alias("j", "hb"))
    rows = written(tables.select(F.xxhash64("i", "j", "ha", "hb").alias("k"), "i", "node", "n"), "minhash-tables")
    # The centre of a group: least by a hash that depends on the first half only, so that a document has few centres.
    centres = rows.groupBy("k").agg(
        F.min(F.struct(F.xxhash64("node", "i").alias("h"), F.col("node").alias("c"), F.col("n").alias("cn"))).alias("m"), F.count("*").alias("size")
    ).where("size > 1").select("k", "m.c", "m.cn", "size")
    near = F.least("n", "cn") * 100 >= F.greatest("n", "cn") * SHARE
    starred = with_counts(rows, centres, "k", "size", "minhash-centres").where("node <> c").select(*_ordered("node", "c"), near.alias("near")).distinct()
    starred = written(starred, "minhash-pairs")
    first = written(_verify(starred.where("near").select("x", "y"), texts).where("linked").select("x", "y"), "minhash-verified")
    comp = written(components(first.select(F.col("x").alias("a"), F.col("y").alias("b")), "minhash"), "minhash-components")
    apart = starred.select("x", "y").join(first, ["x", "y"], "left_anti")
    joined = written(_across(apart, comp, nodes, texts), "minhash-across")
    merged = components(joined, "minhash").select(F.col("node").alias("_c"), F.col("component").alias("_m"))
    final = (
        nodes.select("d1", "d2", "node", F.col("n").alias("_nn")).join(comp.withColumnRenamed("component", "_c"), "node", "left")
        .withColumn("_c", F.coalesce("_c", "node")).join(merged, "_c", "left")
        .select("d1", "d2", F.coalesce("_m", "_c").alias("component"))
    )
    out = signed.select("doc_id", "n", "d1", "d2").join(final, ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def select(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that `near_dedup` keeps: of each component that of the least id.

    Rows without text, without words or without id are linked with nothing and stay. Rows that repeat an id are one document: they stay
    or go together. The order of rows is free; an empty table gives an empty one. Columns keep their names, whatever these are.
    """
    lost = written(near_dedup(docs, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("_lost")).distinct(), "minhash-lost")
    if lost.count() <= BROADCAST_IDS:
        lost = F.broadcast(lost)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("_key"))
    return rows.join(lost, F.col("_key") == F.col("_lost"), "left_anti").select("row.*")
