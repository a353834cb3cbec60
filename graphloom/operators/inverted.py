"""F1 over an index that is built once and asked often: postings in stretches of texts, opened by ranges that can hold a best document.

Each text is read and cut into words once, and its postings are made where it lies: a stretch is some megabytes of texts, sorted by length,
and each `block_docs` of them are a range, as documents of one length have much the same bounds. The largest share that a term has in a
range, summed over a query's terms, bounds every document there, so ranges whose bound is below the k-th score found so far are never
opened, and the top-k stays exact.

A segment is a row: the places in a stretch that hold a term, and how often. The word of no letters stands for the stretch itself: its
documents and their lengths. For a search the segments of words that are asked for are dealt by stretch and batch of queries, so that a
group holds a stretch at most, and passes on its best documents only. The ranges of the best of all are scored where their postings lie,
and only the sums are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import tokens
from graphloom.operators.lexical import COUNTED, DELTA, K1, B  # noqa: F401
from graphloom.shipping import ship
from graphloom.storage import discard, written

#: Documents of a range, and ranges of a stretch that are opened for each query first.
BLOCK_DOCS, FIRST = 4, 32
#: Rows (of about 40 bytes) up to which a side is broadcast: terms of queries, opened ranges.
BROADCAST_ROWS = 500_000
#: Bytes of text of a stretch (one document at least), and terms of queries of a batch.
TEXT_BYTES, BATCH_TERMS = 2**23, 100_000
#: Stretches that a task may make: their numbers begin at that of the task times this.
STRETCHES = 2**12
#: Scores are rounded to six places, so one may be short of another by as much.
ROUNDED = 2e-6


def _share(tf, dl, avgdl):
    return tf * (K1 + 1) / (K1 * (1 - B + B * dl / avgdl) + tf)


def _near(df: DataFrame) -> DataFrame:
    """Broadcast if it is small; `df` is a written table."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _stretches(batches: Iterator) -> Iterator:
    """`doc_id, text` in pieces of `TEXT_BYTES`, or of one document, whatever the batches."""
    import numpy as np
    import pyarrow as pa

    kept, room = [], TEXT_BYTES
    whole = lambda: pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
    for batch in batches:
        ends = np.frombuffer(batch.column(1).buffers()[1], np.int32, batch.num_rows + 1, 4 * batch.column(1).offset) if batch.num_rows else np.zeros(1, np.int32)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + room, "right")) - 1
            if to <= at and kept:
                yield whole()
                kept, room = [], TEXT_BYTES
                continue
            to = max(at + 1, to)
            kept.append(batch.slice(at, to - at))
            room -= int(ends[to] - ends[at])
            at = to
    if kept:
        yield whole()


def _words(batch: object) -> tuple:
    """The words of lower-cased texts are runs of bytes: length of each document; of each word in it the document's place by length, the code and how often; words of the codes."""
    import numpy as np
    import pyarrow as pa

    letter = np.zeros(256, bool)
    letter[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
    texts = batch.column(1)
    edge = np.frombuffer(texts.buffers()[1], np.int32, batch.num_rows + 1, 4 * texts.offset)
    text = np.frombuffer(texts.buffers()[2], np.uint8, edge[-1] - edge[0], edge[0]) if edge[-1] > edge[0] else np.zeros(0, np.uint8)
    edge = edge - edge[0]
    inside = letter[text]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = edge[:-1][edge[:-1] < len(text)]
    first[begin] = inside[begin]
    starts = np.flatnonzero(first)
    dl = np.diff(np.searchsorted(starts, edge))
    letters = text[inside]
    offsets = np.append(np.flatnonzero(first[inside]), len(letters)).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
    each, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False) * np.int64(max(1, len(dl))) + np.repeat(np.argsort(np.argsort(dl, kind="stable")), dl), return_counts=True)
    code, place = np.divmod(each, max(1, len(dl)))
    return dl, place, code, tf, coded.dictionary


def _segments() -> Callable:
    """Documents as segments: `term, shard, n, docs, places, tfs`; a shard is a stretch, sorted by length."""

    def stretch(batch, shard: int) -> object:
        import numpy as np
        import pyarrow as pa

        dl, place, code, tf, words = _words(batch)
        order = np.argsort(dl, kind="stable")
        n, start = len(dl), np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, int)
        # The word of no letters is in every document, as often as that has words.
        ends = pa.array(np.concatenate([[0], n + start, [n + len(code)]]), pa.int32())
        each = lambda values: pa.ListArray.from_arrays(ends, pa.array(values, pa.int32()))
        docs = pa.ListArray.from_arrays(pa.array(np.append(0, np.full(len(start) + 1, n)), pa.int32()), batch.column(0).take(pa.array(order)))
        many = pa.array(np.diff(ends.to_numpy()), pa.int64())
        columns = [pa.concat_arrays([pa.array([""]), words]), pa.array(np.full(len(many), shard), pa.int32()), many, docs, each(np.append(np.arange(n), place)), each(np.append(dl[order], tf))]
        return pa.RecordBatch.from_arrays(columns, ["term", "shard", "n", "docs", "places", "tfs"])

    def run(batches: Iterator) -> Iterator:
        task = TaskContext.get().partitionId()
        for i, batch in enumerate(_stretches(batches)):
            if i == STRETCHES:
                raise ValueError("the texts of a task are too many: deal them to more")
            yield stretch(batch, task * STRETCHES + i)

    return run


def build(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS, shards: int | None = None) -> Index:
    """Writes the index of `docs` below `path`: segments, documents, figures.

    A null text has no tokens, its document counts. Rows without id are passed over, rows that repeat an id are one document of all
    their texts. Stretches are made where the documents lie; with `shards` these are dealt out to so many tasks before.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"term string, shard int, n long, docs array<{kind}>, places array<int>, tfs array<int>"
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.lower(F.coalesce(text, F.lit(""))).alias("text"))

    def count(rows: DataFrame) -> DataFrame:
        rows = rows.repartition(shards, "doc_id") if shards else rows
        rows.mapInArrow(_segments(), schema).write.mode("overwrite").parquet(f"{path}/segments")
        whole = spark.read.schema(schema).parquet(f"{path}/segments").where("term = ''").select(F.explode(F.arrays_zip("docs", "tfs")).alias("x"))
        return written(whole.select(F.col("x.docs").alias("doc_id"), F.col("x.tfs").cast("long").alias("dl")), "inverted-counted")

    counted = count(rows)
    if counted.groupBy("doc_id").count().where("count > 1").limit(1).count():
        discard(counted)
        counted = count(rows.groupBy("doc_id").agg(F.array_join(F.collect_list("text"), " ").alias("text")))
    counted.write.parquet(f"{path}/docs")
    figures = counted.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.col("dl").cast("double")), F.lit(0.0)).alias("avgdl"), F.lit(block_docs).alias("block_docs"))
    figures.write.parquet(f"{path}/figures")
    discard(counted)
    return load(spark, path)


def _best(top_k: int, first: int, avgdl: float, block_docs: int) -> Callable:
    """The asked segments of a stretch as the ranges of each query's best documents there: all that can be among the `top_k`, ties and all."""

    def run(table: object) -> object:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        flat = lambda t, name: t.column(name).combine_chunks().flatten()
        ints = lambda name: flat(asked, name).to_numpy(zero_copy_only=False)
        lengths = lambda name: pc.list_value_length(asked.column(name)).to_numpy()
        whole, asked = table.filter(pc.equal(table["term"], "")), table.filter(pc.not_equal(table["term"], ""))
        ids, dl = flat(whole, "docs"), flat(whole, "tfs").to_numpy(zero_copy_only=False)
        shard = whole["shard"][0].as_py() << 32
        nth = np.empty(len(dl), int)
        nth[pc.sort_indices(ids).to_numpy()] = np.arange(len(dl))
        place, ends = ints("places"), np.append(0, np.cumsum(lengths("places")))
        share, block = _share(ints("tfs"), dl[place], avgdl), place // block_docs
        head = np.append(True, block[1:] != block[:-1])
        head[ends[:-1]] = True
        head = np.flatnonzero(head)
        most, range_at, heads = np.maximum.reduceat(share, head), block[head], np.searchsorted(head, ends)
        coded = flat(asked, "queries").dictionary_encode()
        query, weight = coded.indices.to_numpy(zero_copy_only=False), ints("weights")
        order = np.argsort(query, kind="stable")
        row = np.repeat(np.arange(asked.num_rows), lengths("queries"))[order]
        weight, cut = weight[order], np.searchsorted(query[order], np.arange(len(coded.dictionary) + 1))
        at, blocks, parts, told = [], [], [], []

        def spread(edges, rows, weights):
            n = edges[rows + 1] - edges[rows]
            return np.repeat(edges[rows] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum()), np.repeat(weights, n)

        for q in range(len(coded.dictionary)):
            rows, weights = row[cut[q] : cut[q + 1]], weight[cut[q] : cut[q + 1]]
            i, w = spread(heads, rows, weights)
            bound = np.bincount(range_at[i], most[i] * w)
            i, w = spread(ends, rows, weights)
            where, range_of = place[i], block[i]

            def scored(opened):
                hit = opened[range_of]
                part = np.bincount(where[hit], share[i[hit]] * w[hit])
                found = np.flatnonzero(part)
                return found, part[found], int(hit.sum())

            opened = bound > 0
            ranges = int(opened.sum())
            if ranges > first:
                begun = np.zeros(len(bound), bool)
                begun[np.argpartition(bound, -first)[-first:]] = True
                _, part, _ = scored(begun)
                if len(part) >= top_k:
                    opened = begun | (bound + ROUNDED >= np.partition(part, -top_k)[-top_k])
            found, part, n = scored(opened)
            if len(part) > top_k:
                near = part >= np.partition(part, -top_k)[-top_k] - ROUNDED
                found, part = found[near], part[near]
                by = np.lexsort((nth[found], -part))
                found, part = found[by], part[by]
                same = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                few = np.arange(len(part)) - np.repeat(same, np.diff(np.append(same, len(part)))) < top_k
                found, part = found[few], part[few]
            at.append(np.full(len(found), q))
            blocks.append(found)
            parts.append(part)
            told.append([[len(i), n, ranges, int(opened.sum())], *[[0] * 4] * (len(found) - 1)])
        if not at:
            return pa.table([coded.dictionary, ids.slice(0, 0), *[pa.array([], pa.int64())], pa.array([], pa.float64()), *[pa.array([], pa.int64())] * 4], ["query_id", "doc_id", "block", "part", *FIGURES])
        found = np.concatenate(blocks)
        figures = np.concatenate([np.array(x) for x in told]).T
        columns = [coded.dictionary.take(pa.array(np.concatenate(at))), ids.take(pa.array(found)), pa.array(shard + found // block_docs), pa.array(np.concatenate(parts)), *map(pa.array, figures)]
        return pa.table(columns, ["query_id", "doc_id", "block", "part", *FIGURES])

    return run


#: What a search took: postings of the query's terms and those that were scored, ranges with a term of the query and those that were opened.
FIGURES = ("n_postings", "n_scored", "n_blocks", "n_opened")


@dataclass(frozen=True)
class Index:
    docs: DataFrame
    rows: DataFrame
    n: int
    avgdl: float
    block_docs: int

    @property
    def terms(self) -> DataFrame:
        """Words, how many documents have them, and what that makes them weigh."""
        return self._weighed(self.rows.where("term <> ''"))

    @property
    def segments(self) -> DataFrame:
        """Segments of words, with the documents and the ranges that hold them."""
        ids = self.rows.where("term = ''").select("shard", F.col("docs").alias("ids"))
        every = self.rows.where("term <> ''").drop("docs").join(ids, "shard")
        blocks = F.array_distinct(F.transform("places", lambda p: self._block(F.col("shard"), p)))
        return every.select("term", "shard", "n", blocks.alias("blocks"), F.transform("places", lambda p: F.get("ids", p)).alias("docs"), "places", "tfs")

    def _block(self, shard: Column, place: Column) -> Column:
        return shard * F.lit(2**32) + F.floor(place / self.block_docs)

    def _weighed(self, rows: DataFrame) -> DataFrame:
        df = rows.groupBy("term").agg(F.sum("n").alias("df"))
        return df.select("term", "df", F.log((F.lit(self.n) + 1) / F.col("df")).alias("idf"))

    def search(self, queries: DataFrame, top_k: int = 10, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
        """The top `top_k` for each of `queries(query_id, text)`: `query_id, doc_id, score, rank`, as `lexical.bm25plus` gives them; and
        what that took: `query_id, n_postings, n_scored, n_blocks, n_opened`, blocks being ranges with a term of the query.
        """
        wanted = written(queries.select("query_id", F.explode(tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")), "inverted-wanted")
        words = written(wanted.select("term").distinct(), "inverted-wanted-words")
        terms = self._weighed(self.rows.join(_near(words), "term", "left_semi"))
        known = written(terms.join(_near(wanted), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")), "inverted-asked")
        base = written(known.groupBy("query_id").agg(F.sum(F.col("weight") * DELTA).alias("base")), "inverted-base")
        found = written(self._found(known, top_k, first), "inverted-found")
        best = Window.partitionBy("query_id").orderBy(F.col("part").desc(), "doc_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        same = Window.partitionBy("query_id", "part").orderBy("doc_id")
        kept = found.withColumn("kth", F.nth_value("part", top_k).over(best)).where(F.col("kth").isNull() | (F.col("part") >= F.col("kth") - ROUNDED))
        kept = kept.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= top_k).select("query_id", "block").distinct()
        opened = written(kept.join(_near(base), "query_id"), "inverted-kept")
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
        ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)
        found_k = written(ranked(self._scored(_near(known), opened)).select("query_id", "doc_id", "score"), "inverted-best")
        # Queries with fewer: the first other documents in tie order are among the first 2k.
        count = found_k.groupBy("query_id").agg(F.count("*").alias("m"))
        short = base.join(count, "query_id", "left").where(F.coalesce("m", F.lit(0)) < top_k).select("query_id", "base")
        filler = self.docs.select("doc_id").orderBy("doc_id").limit(2 * top_k)
        extra = short.crossJoin(F.broadcast(filler)).join(found_k.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
        every = ranked(found_k.unionByName(extra.select("query_id", "doc_id", F.round("base", 6).alias("score")))).where("score > 0")
        return every.select("query_id", "doc_id", "score", "rank"), found.groupBy("query_id").agg(*(F.sum(c).alias(c) for c in FIGURES))

    def _found(self, known: DataFrame, top_k: int, first: int) -> DataFrame:
        """Documents that can be among the best of a query, as far as their stretch tells, with their ranges; `known` is a written table."""
        ship(known.sparkSession)
        batches = max(1, -(-known.count() // BATCH_TERMS))
        batch = F.pmod(F.hash("query_id"), F.lit(batches)).alias("batch")
        words = known.groupBy("term", batch).agg(F.collect_list("query_id").alias("queries"), F.collect_list("weight").alias("weights"))
        none = known.select(F.lit("").alias("term"), batch).distinct().select("*", *(F.array().cast(words.schema[c].dataType).alias(c) for c in ("queries", "weights")))
        words = _near(written(words.unionByName(none), "inverted-words"))
        rows = self.rows.join(words, "term").select("shard", "batch", "term", "docs", "places", "tfs", "queries", "weights")
        kinds = [known.schema["query_id"].dataType.simpleString(), self.docs.schema["doc_id"].dataType.simpleString()]
        schema = f"query_id {kinds[0]}, doc_id {kinds[1]}, block long, part double, " + ", ".join(f"{c} long" for c in FIGURES)
        return rows.groupBy("shard", "batch").applyInArrow(_best(top_k, first, self.avgdl, self.block_docs), schema)

    def _scored(self, asked: DataFrame, opened: DataFrame) -> DataFrame:
        """Scores of all documents of the opened ranges that hold a term of the query. Where these are many, shards take turns, so that
        what is broadcast stays small and postings stay where they lie.
        """
        whole = self.rows.where("term = ''").select("shard", "tfs", F.posexplode("docs").alias("place", "doc_id"))
        whole = whole.select("shard", "place", "doc_id", F.get("tfs", F.col("place")).alias("dl"), self._block(F.col("shard"), F.col("place")).alias("block"))
        opened = written(whole.join(_near(written(opened, "inverted-ranges")), "block").select("query_id", "shard", "place", "doc_id", "dl", "base"), "inverted-opened")
        turns = _turns([(r.shard, r["count"]) for r in opened.groupBy("shard").count().orderBy("shard").collect()])  # a row a shard
        words = _near(written(asked.select("term").distinct(), "inverted-words"))
        hits = reduce(DataFrame.unionByName, (self._hits(words, asked, opened, t, small) for t, small in turns))
        parts = hits.groupBy("query_id", "doc_id").agg(F.sum("part").alias("part"), F.first("base").alias("base"))
        return parts.select("query_id", "doc_id", F.round(F.col("base") + F.col("part"), 6).alias("score"))

    def _hits(self, words: DataFrame, asked: DataFrame, opened: DataFrame, shards: list[int], small: bool) -> DataFrame:
        own = lambda df: df.where(_between("shard", shards))
        opened, places = own(opened), ["shard", "place"]
        rows = own(self.rows).join(words, "term", "left_semi").select("term", "shard", "tfs", F.posexplode("places").alias("i", "place"))
        rows = rows.select("term", "shard", "place", F.get("tfs", F.col("i")).alias("tf"))
        if small:
            rows = rows.join(F.broadcast(opened.select(places).distinct()), places, "left_semi")
        rows = rows.join(asked, "term").join(F.broadcast(opened) if small else opened, ["query_id", *places])
        return rows.select("query_id", "doc_id", (F.col("weight") * _share(F.col("tf"), F.col("dl"), F.lit(self.avgdl))).alias("part"), "base")


def _between(name: str, shards: list[int]) -> Column:
    return F.col(name).between(shards[0], shards[-1]) if shards else F.lit(False)


def _turns(counts: list[tuple[int, int]]) -> list[tuple[list[int], bool]]:
    """Shards in order with `BROADCAST_ROWS` rows of opened ranges together at most, and whether they keep to that: one by itself may not."""
    out: list[tuple[list[int], int]] = []
    for shard, n in counts:
        if out and out[-1][1] + n <= BROADCAST_ROWS:
            out[-1] = ([*out[-1][0], shard], out[-1][1] + n)
        else:
            out.append(([shard], n))
    return [(shards, n <= BROADCAST_ROWS) for shards, n in out] or [([], True)]


def load(spark: SparkSession, path: str) -> Index:
    """An index that `build` has written."""
    figures = spark.read.parquet(f"{path}/figures").first()
    return Index(spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/segments"), figures.n, figures.avgdl, figures.block_docs)
