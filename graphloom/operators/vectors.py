"""F2, A8 for many queries: blocks of queries meet blocks of vectors, over whole tables or over clusters that are written once.

Neither side passes through the driver: queries and vectors are dealt into blocks of bounded size, a task multiplies one block of either and
keeps the best of each query, and these are merged. A clustered table has a centroid and a radius for each cluster: no
vector of a cluster scores above q.c + radius, so clusters below the k-th score found so far are left out, and the top-k is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.shipping import ship
from graphloom.storage import written

#: Rows of a block of either side, clusters at most, vectors that they are fitted on for each, and clusters asked first.
VECTORS, QUERIES, CLUSTERS, SAMPLE, FIRST = 16_384, 2_048, 1_024, 16, 2
#: Queries and vectors of a block that are multiplied at a time.
PIECE = 512
#: Scores are rounded to six places, so a bound may be short of one by as much.
ROUNDED = 2e-6


def unit_rows(lists):
    """Arrow lists of one length as rows of length 1; zero vectors stay."""
    import numpy as np

    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    m = flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def _column(table, name: str):
    import pyarrow as pa

    return pa.concat_arrays(table.column(name).chunks)


def _best(k: int, kinds: list) -> Callable:
    """Of a block of queries and one of vectors: `k` rows at most for each query, equal scores by id.

    Products are made of PIECE queries and PIECE vectors at a time, and what is kept is merged into the best so far, so what a task holds besides
    the blocks does not grow with them, however many scores are equal. Vectors come by id: of equal scores the one that is there first stays.
    """

    def run(queries, vectors):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        out: list[list] = [[], [], []]
        if queries.num_rows and vectors.num_rows:
            names, q = _column(queries, "query_id"), unit_rows(_column(queries, "embedding"))
            ids = _column(vectors, "id")
            order = pc.sort_indices(ids)
            ids, v = ids.take(order), unit_rows(_column(vectors, "embedding"))[order.to_numpy()]
            least = _column(queries, "least").to_numpy(zero_copy_only=False) if "least" in queries.column_names else np.full(len(q), -np.inf)
            for at in range(0, len(q), PIECE):
                part, floor = q[at : at + PIECE], least[at : at + PIECE]
                kth = np.full(len(part), -np.inf)
                who, place, score = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
                for begin in range(0, len(v), PIECE):
                    s = np.round(part @ v[begin : begin + PIECE].T, 6) + 0.0  # no negative zeros
                    near = (s > kth[:, None]) & (s >= floor[:, None])
                    if s.shape[1] > k and np.count_nonzero(near) > 2 * k * len(part):
                        near &= s >= np.partition(np.nan_to_num(s, nan=-np.inf), -k, axis=1)[:, -k, None]
                    rows, cols = np.nonzero(near)
                    if not len(rows):
                        continue
                    who, place, score = np.append(who, rows), np.append(place, begin + cols), np.append(score, s[rows, cols])
                    best = np.lexsort((place, -score, who))
                    who, place, score = who[best], place[best], score[best]
                    first = np.searchsorted(who, np.arange(len(part) + 1))
                    kept = np.arange(len(who)) - first[who] < k
                    full = np.flatnonzero(np.diff(first) >= k)
                    kth[full] = score[first[full] + k - 1]
                    who, place, score = who[kept], place[kept], score[kept]
                for column, values in zip(out, (names.take(pa.array(at + who)), ids.take(pa.array(place)), pa.array(score)), strict=True):
                    column.append(values)
        return pa.table([pa.chunked_array(c, t) for c, t in zip(out, (*kinds, pa.float64()), strict=True)], ["query_id", "id", "score"])

    return run


def _met(queries: DataFrame, vectors: DataFrame, key: list[str], k: int) -> DataFrame:
    """The best `k` for each query over blocks of one key."""
    from pyspark.sql.pandas.types import to_arrow_type

    ship(queries.sparkSession)
    kinds = [queries.schema["query_id"].dataType, vectors.schema["id"].dataType]
    schema = f"query_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, score double"
    found = queries.groupBy(*key).cogroup(vectors.groupBy(*key)).applyInArrow(_best(k, [to_arrow_type(t) for t in kinds]), schema)
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _dealt(df: DataFrame, by: str, blocks: int, name: str):
    return df.withColumn(name, F.pmod(F.xxhash64(by), F.lit(blocks)).cast("int"))


def _every(blocks: int):
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))


def topk(vectors: DataFrame, queries: DataFrame, k: int = 10, vector_rows: int = VECTORS, query_rows: int = QUERIES) -> DataFrame:
    """F2: the `k` nearest of `vectors(id, embedding)` for each of `queries(query_id, embedding)`: `query_id, id, score, rank`.

    A grid of blocks: every block of queries meets every block of vectors once, in one plan however many there are.
    """
    queries, vectors = queries.select("query_id", "embedding"), vectors.select("id", "embedding")
    nv, nq = (max(1, -(-df.count() // size)) for df, size in ((vectors, vector_rows), (queries, query_rows)))
    left = _dealt(queries, "query_id", nq, "qb").withColumn("vb", _every(nv))
    right = _dealt(vectors, "id", nv, "vb").withColumn("qb", _every(nq))
    return _met(left, right, ["qb", "vb"], k)


@dataclass(frozen=True)
class Clustered:
    """A written table of vectors by cluster, and its centroids: `cluster, centroid, radius, n`, CLUSTERS rows at most."""

    vectors: DataFrame
    centroids: DataFrame

    def search(self, queries: DataFrame, k: int = 10, first: int = FIRST, vector_rows: int = VECTORS, query_rows: int = QUERIES) -> tuple[DataFrame, DataFrame]:
        """As `topk`; and what it took: `query_id, n_vectors, n_scored`."""
        queries = written(queries.select("query_id", "embedding"), "vectors-asked")
        blocks = max(1, -(-queries.count() // query_rows))
        shards = F.broadcast(self.centroids.select("cluster", F.ceil(F.col("n") / vector_rows).cast("int").alias("shards")))
        heads = self.centroids.orderBy("cluster").collect()  # CLUSTERS at most
        near = written(queries.mapInArrow(_bounds([h.cluster for h in heads], [list(h.centroid) for h in heads], [h.radius for h in heads]), _bound_schema(queries)), "vectors-near")
        order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "cluster")
        near = near.withColumn("nth", F.row_number().over(order))

        def asked(which: DataFrame) -> DataFrame:
            rows = _dealt(which.join(queries, "query_id"), "query_id", blocks, "qb").join(shards, "cluster")
            rows = rows.withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
            wanted = rows.groupBy("cluster").agg(F.collect_set("qb").alias("qbs"))  # a row a cluster
            own = self.vectors.join(shards, "cluster").withColumn("vb", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int")).drop("shards")
            own = own.join(F.broadcast(wanted), "cluster").withColumn("qb", F.explode("qbs")).drop("qbs")
            return _met(rows, own, ["cluster", "vb", "qb"], k)

        near = written(near, "vectors-clusters")
        early = written(asked(near.where(F.col("nth") <= first).select("query_id", "cluster")).drop("rank"), "vectors-early")
        kth = early.groupBy("query_id").agg(F.count("*").alias("m"), F.min("score").alias("least")).where(F.col("m") == k).select("query_id", "least")
        later = near.where(F.col("nth") > first).join(kth, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        later = written(later.where(F.col("bound") + ROUNDED >= F.col("least")).select("query_id", "cluster", "least"), "vectors-later")
        best = _ranked(early.unionByName(asked(later).drop("rank")), k)
        opened = near.where(F.col("nth") <= first).select("query_id", "cluster").unionByName(later.select("query_id", "cluster"))
        sizes = F.broadcast(self.centroids.select("cluster", "n"))
        total = self.centroids.agg(F.sum("n").alias("n_vectors"))
        return best, opened.join(sizes, "cluster").groupBy("query_id").agg(F.sum("n").alias("n_scored")).crossJoin(F.broadcast(total))


def _bound_schema(queries: DataFrame) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, cluster int, bound double"


def _bounds(clusters: list[int], centroids: list[list[float]], radii: list[float]) -> Callable:
    """The most that a vector of each cluster can score for each query."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        c, r = np.array(centroids, float), np.array(radii, float)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                bound = unit_rows(part.column(1)) @ c.T + r if len(c) else np.zeros((part.num_rows, 0))
                who = pa.array(np.repeat(np.arange(part.num_rows), len(clusters)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(who), pa.array(np.tile(np.array(clusters, np.int32), part.num_rows)), pa.array(bound.ravel())], ["query_id", "cluster", "bound"])

    return run


def cluster(vectors: DataFrame, path: str, clusters: int | None = None) -> Clustered:
    """Writes `vectors(id, embedding)` below `path`, each in the cluster of its nearest centroid, and the centroids.

    Centroids are fitted on a bounded sample (the SAMPLE vectors a cluster of the least id hashes), every vector is dealt to one.
    There are about as many clusters as vectors in each, CLUSTERS at most.
    """
    import numpy as np

    spark = vectors.sparkSession
    ship(spark)
    n = vectors.count()
    k = max(1, min(CLUSTERS, clusters or int(n**0.5)))
    sample = np.array([r.embedding for r in vectors.select("embedding", "id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE * k).collect()], float)
    if len(sample):
        norm = np.linalg.norm(sample, axis=1, keepdims=True)
        sample /= np.where(norm == 0, 1, norm)
    centres = sample[:k].copy()
    for _ in range(4):
        own = (sample @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1) if len(sample) else np.zeros(0, int)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = sample[own == c].mean(axis=0)

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                v = unit_rows(part.column(1))
                own = (v @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
                off = np.linalg.norm(v - centres[own], axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, pa.int32()), pa.array(off)], [*part.schema.names, "cluster", "off"])

    rows = vectors.select("id", "embedding")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = written(rows.mapInArrow(deal, f"{schema}, cluster int, off double"), "vectors-dealt")
    dealt.drop("off").repartitionByRange("cluster", "id").write.partitionBy("cluster").parquet(f"{path}/vectors")
    made = spark.createDataFrame([(i, c) for i, c in enumerate(centres.tolist())], "cluster int, centroid array<double>")
    sizes = dealt.groupBy("cluster").agg(F.max("off").alias("radius"), F.count("*").alias("n"))
    made.join(sizes, "cluster").select("cluster", "centroid", (F.col("radius") + 1e-9).alias("radius"), "n").write.parquet(f"{path}/centroids")
    return load(spark, path, schema)


def load(spark: SparkSession, path: str, schema: str = "id long, embedding array<double>") -> Clustered:
    """A table that `cluster` has written; `schema` is that of its vectors."""
    own = spark.read.schema(f"{schema}, cluster int").parquet(f"{path}/vectors")
    return Clustered(own, spark.read.schema("cluster int, centroid array<double>, radius double, n long").parquet(f"{path}/centroids"))
