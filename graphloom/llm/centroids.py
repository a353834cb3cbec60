"""Centroid clustering by Delta Lloyd, in whole numbers.

Each vector's cluster and distance are persisted beside it, and so are the sums and counts of all clusters. In a round only
the centroids that changed are compared: a vector whose owner stayed needs no distance but those to them, one whose owner moved
is compared with all. Vectors that change their cluster are gathered as signed transfers, one row a task and cluster, and
added to the sums; nothing else is summed again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.storage import discard, new_path

from .common import map_arrow, pieces, written
from .negatives import finite, quantized

#: Components below this are multiplied as doubles without rounding, 64 of them at most.
SMALL = 1 << 22


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of integers, exact."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < SMALL and x.shape[1] <= 64:
        a, b = x.astype(np.float64), c.astype(np.float64)
    else:
        a, b = x, c
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)


class _Assign:
    """Assigns anew; rows of kind 0 are the vectors, rows of kind 1 what a task moved into (and out of) a cluster."""

    def __init__(self, centroids: np.ndarray, changed: np.ndarray):
        self.centroids, self.changed = centroids, changed

    def __call__(self, batches: Iterator) -> Iterator:
        import pyarrow as pa

        k, dims = self.centroids.shape
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        vectors = pa.list_(pa.int64())
        names = ["vec_id", "v", "cluster", "distance", "kind"]
        moved = np.flatnonzero(self.changed)
        for batch in pieces(batches, 4096):
            n = batch.num_rows
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, dims)
            old = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            own, dist = old.copy(), batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64).copy()
            lost = np.flatnonzero((old < 0) | self.changed[old])
            if len(lost):
                d = squared(x[lost], self.centroids)
                own[lost] = d.argmin(axis=1)  # the first of equal ones
                dist[lost] = d[np.arange(len(lost)), own[lost]]
            stay = np.flatnonzero((old >= 0) & ~self.changed[old])
            if len(stay) and len(moved):
                d = squared(x[stay], self.centroids[moved])
                best = d.argmin(axis=1)
                near, to = d[np.arange(len(stay)), best], moved[best]
                better = (near < dist[stay]) | ((near == dist[stay]) & (to < own[stay]))
                own[stay[better]], dist[stay[better]] = to[better], near[better]
            went = np.flatnonzero(own != old)
            for to, sign in ((own, 1), (old, -1)):
                for c in np.unique(to[went]).tolist():
                    if c >= 0:
                        part = went[to[went] == c]
                        counts[c] += sign * len(part)
                        sums[c] += sign * x[part].sum(axis=0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(vectors), pa.array(own, pa.int32()), pa.array(dist, pa.int64()), pa.array(np.zeros(n, np.int32))], names
            )
        used = np.flatnonzero((counts != 0) | sums.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(counts[used], pa.int64()), pa.array(sums[used].tolist(), vectors), pa.array(used, pa.int32()), pa.array(np.zeros(len(used), np.int64)), pa.array(np.ones(len(used), np.int32))], names
            )


def _persisted(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assignments and transfers, in one table of the shared folder with a folder for either."""
    path = new_path(df.sparkSession, "centroids")
    df.write.partitionBy("kind").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    rows, moves = (out.where(f"kind = {i}").drop("kind") for i in (0, 1))
    rows._written_at = path
    return rows, moves


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1:") -> DataFrame:
    """`vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256` of each of rows(vec_id, embedding) that is clustered.

    Vectors with exactly `dims` components, none null or non-finite, take part, as floor(scale * x) (held to 2 ** 26 either
    way). Centroids start as the k vectors with the least sha256 of seed and vec_id, equal hashes by vector; there are fewer if there are fewer
    vectors. Rows without vec_id are clustered, but start no centroid. Rows that repeat are vectors each. Equal distances go
    to the smaller cluster, empty clusters keep their centroid, an empty table gives an empty result, other columns are ignored.
    """
    good = rows.where((F.size("embedding") == dims) & finite("embedding"))
    start = good.select(F.col("vec_id").cast("long").alias("vec_id"), quantized("embedding", scale).cast("array<long>").alias("v"))
    start = start.withColumns({"cluster": F.lit(-1), "distance": F.lit(-1).cast("long")})
    state = written(start, "centroids-start")
    hashed = state.where("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    first = hashed.orderBy("h", "v").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return rows.sparkSession.createDataFrame([], schema)
    centroids = np.array([r.v for r in first], np.int64)
    changed, counts, sums = np.ones(len(first), bool), [0] * len(first), [[0] * dims for _ in first]
    for done in range(rounds + 1):
        before = state
        step = map_arrow(before.select("vec_id", "v", "cluster", "distance"), _Assign(centroids, changed), "vec_id long, v array<long>, cluster int, distance long, kind int")
        state, moves = _persisted(step)
        discard(before)
        if done == rounds:
            break
        # One row a cluster and component.
        for r in moves.select("cluster", "vec_id", F.posexplode("v").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum("x").alias("x"), F.sum("vec_id").alias("n")).collect():
            sums[r.cluster][r.pos] += r.x
            counts[r.cluster] += r.n if r.pos == 0 else 0
        new = np.array([[s // counts[i] for s in sums[i]] if counts[i] else centroids[i].tolist() for i in range(len(first))], np.int64)
        changed, centroids = (new != centroids).any(axis=1), new
    per = {r.cluster: int(r.d) for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    made = rows.sparkSession.createDataFrame([(i, per.get(i, 0), sum(per.values()), h) for i, h in enumerate(digest)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(made), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def duckdb_sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1:") -> str:
    """The same over DuckDB, each round spelled out."""
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, [floor({scale} * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings "
        f"WHERE len(embedding) = {dims} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {dims})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS cluster, v AS c FROM "
        f"(SELECT sha256('{seed}' || vec_id) AS h, v FROM v WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"a{i} AS MATERIALIZED (SELECT vec_id, v, cluster, (list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c))::BIGINT AS distance "
            f"FROM v CROSS JOIN c{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)"
        )
        if i < rounds:
            parts.append(
                f"m{i} AS (SELECT cluster, list(m ORDER BY pos) AS c FROM (SELECT cluster, pos, floor(sum(x) / count(*)) AS m FROM "
                f"(SELECT cluster, unnest(v) AS x, unnest(range({dims})) AS pos FROM a{i}) GROUP BY cluster, pos) GROUP BY cluster)"
            )
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.c, o.c) AS c FROM c{i} AS o LEFT JOIN m{i} AS m USING (cluster))")
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, a.cluster, distance, sum(distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia, "
        f"sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string([x::BIGINT FOR x IN c], ',')) AS centroid_sha256 FROM a{rounds} AS a JOIN c{rounds} AS c USING (cluster)"
    )
