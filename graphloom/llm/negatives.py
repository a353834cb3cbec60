"""Hard-negative mining with vantage-point trees over norm-augmented vectors.

Every vector x of integers gets one more component, sqrt(M - |x|^2), M being the largest squared norm, and a query q gets 0
there. Then |q - x|^2 = |q|^2 + M - 2 q.x: higher inner products are smaller distances, and a window of scores is an annulus
around the query. A vantage-point tree bounds the distance of a query to each of its leaves by the triangle inequality, so the
leaves that an annulus misses are left out and the others are read nearest first, until no leaf can hold a better row.

The upper levels of the tree are fitted on a bounded sample and deal all rows into cells (large cells into shards); each
task holds one shard with a tree of its own and the queries whose annulus meets the cell. A first round asks the nearest cell
only; its k-th score narrows the annulus before all other cells are asked. The result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.shipping import ship

from .common import map_arrow, pieces, written

#: Quantised components are held to this range, so that inner products of up to 1,024 components fit a long.
BOUND = 1 << 26
#: Rows that a task holds about, queries that meet them at a time, rows of a leaf, and cells of the upper tree at most.
CELL_ROWS, QUERY_ROWS, LEAF_ROWS, MAX_CELLS = 16_384, 2_048, 256, 4_096
#: The upper tree is fitted on so many rows a cell, those of the least id hashes.
SAMPLE_ROWS = 8
#: No score is outside.
FAR = 1 << 62


def finite(vector: str) -> Column:
    """Whether a vector is not null and holds neither nulls nor NaN or infinities."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))), F.lit(False))


def quantized(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component, held to BOUND."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(float(-BOUND)), F.least(F.lit(float(BOUND)), x.cast("double") * scale))).cast("int"))


def matrix(lists, dims: int) -> np.ndarray:
    """Rows of an Arrow list array; those that are shorter end in zeros."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    if len(flat) == len(size) * dims and (size == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(size), dims))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 1 << 53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Tree:
    """A vantage-point tree over the rows of `x` with their last component; `leaves` lists their row numbers."""

    def __init__(self, x: np.ndarray, most: float, leaf_rows: int, tight: bool):
        """tight: bounds are those of these rows; else of all rows that the radii deal to a leaf."""
        self.most, self.slack = most, 1e-6 * (most**0.5 + 1)
        self.norms = (x * x).sum(axis=1)
        self.last = np.sqrt(np.maximum(most - self.norms, 0))
        self.at, self.radius, self.child, self.leaves, paths = [], [], [], [], []
        #: Rows still to be split, the path to them as (node, least, largest distance), and where their number goes.
        todo = [(np.arange(len(x)), [], None)]
        while todo:
            rows, path, up = todo.pop()
            if len(rows) > leaf_rows:
                far = self._apart(x, rows, rows[0])
                at = int(rows[int(far.argmax())])
                d = self._apart(x, rows, at)
                r = float(np.median(d))
                inside = d <= r
                if not inside.all():
                    node = len(self.at)
                    self.at.append(at)
                    self.radius.append(r)
                    self.child.append([0, 0])
                    if up:
                        self.child[up[0]][up[1]] = node
                    for side, part in ((0, inside), (1, ~inside)):
                        low, high = (float(d[part].min()), float(d[part].max())) if tight else ((0.0, r) if side == 0 else (r, np.inf))
                        todo.append((rows[part], [*path, (node, low, high)], (node, side)))
                    continue
            if up:
                self.child[up[0]][up[1]] = -1 - len(self.leaves)
            self.leaves.append(rows)
            paths.append(path)
        self.points, self.point_last = x[self.at], self.last[self.at]
        self.child, self.radius = np.array(self.child, int).reshape(-1, 2), np.array(self.radius)
        deep = max(map(len, paths))
        self.node, self.low, self.high = np.zeros((len(paths), deep), int), np.full((len(paths), deep), -np.inf), np.full((len(paths), deep), np.inf)
        for i, path in enumerate(paths):
            for j, (node, low, high) in enumerate(path):
                self.node[i, j], self.low[i, j], self.high[i, j] = node, low, high

    def _apart(self, x: np.ndarray, rows: np.ndarray, at: int) -> np.ndarray:
        d = ((x[rows] - x[at]) ** 2).sum(axis=1) + (self.last[rows] - self.last[at]) ** 2
        return np.sqrt(d)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The number of the leaf that each row belongs to."""
        last = np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))
        at = np.full(len(x), 0 if len(self.child) else -1)
        while len(open_ := np.flatnonzero(at >= 0)):
            node = at[open_]
            d = np.sqrt(((x[open_] - self.points[node]) ** 2).sum(axis=1) + (last[open_] - self.point_last[node]) ** 2)
            at[open_] = self.child[node, (d > self.radius[node]).astype(int)]
        return -1 - at

    def scores(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score that each leaf may hold for each query, as queries x leaves."""
        square = (q * q).sum(axis=1)[:, None] + self.most
        d = np.sqrt(np.maximum(square - 2 * (q @ self.points.T), 0)) if len(self.points) else np.zeros((len(q), 1))
        near, far = np.zeros((len(q), len(self.leaves))), np.full((len(q), len(self.leaves)), np.inf)
        for j in range(self.node.shape[1]):
            own = d[:, self.node[:, j]]
            near = np.maximum(near, np.maximum(own - self.high[:, j], self.low[:, j] - own))
            far = np.minimum(far, own + self.high[:, j])
        room = 1 + 1e-9 * self.most
        return (square - (far + self.slack) ** 2) / 2 - room, (square - np.maximum(near - self.slack, 0) ** 2) / 2 + room


def nearest(tree: Tree, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, own: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
    """For windows `low..high` of the queries `of`: up to k rows with the highest scores in the window, ties by smaller id,
    of the query's own label or of others. Leaves are read nearest first. Returns window, id and score of each row.
    """
    least, most = tree.scores(q)
    reach = np.minimum(most[of], high[:, None].astype(float))
    reach[(most[of] < low[:, None]) | (least[of] > high[:, None])] = -np.inf
    order = np.argsort(-reach, axis=1, kind="stable")
    floor_, every = low.astype(np.int64).copy(), np.arange(len(of))
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for step in range(len(tree.leaves)):
        leaf = order[:, step]
        open_ = np.flatnonzero(reach[every, leaf] >= floor_)
        if not len(open_):
            break
        open_ = open_[np.argsort(leaf[open_], kind="stable")]
        ends = np.flatnonzero(np.diff(leaf[open_])) + 1
        found = [best]
        for group in np.split(open_, ends):
            rows = tree.leaves[leaf[group[0]]]
            who, back = np.unique(of[group], return_inverse=True)
            s = products(q[who], x[rows])[back]
            fits = ((own[who][:, None] == labels[rows][None, :]) == same)[back]
            fits &= (s >= floor_[group][:, None]) & (s <= high[group][:, None])
            i, j = np.nonzero(fits)
            found.append((group[i], ids[rows[j]], s[i, j]))
        w, i, s = (np.concatenate(z) for z in zip(*found, strict=True))
        sort = np.lexsort((i, -s, w))
        w, i, s = w[sort], i[sort], s[sort]
        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.zeros(0, int)
        rank = np.arange(len(w)) - np.repeat(first, np.diff(np.r_[first, len(w)]))
        best = (w[rank < k], i[rank < k], s[rank < k])
        full = rank == k - 1
        floor_[w[full]] = np.maximum(floor_[w[full]], s[full])
    return best


class _Cells:
    """Deals rows into cells of the upper tree, and queries to the cells that their windows meet."""

    def __init__(self, tree: Tree, dims: int):
        self.tree, self.dims = tree, dims

    def rows(self, batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches, 8192):
            cell = self.tree.leaf_of(matrix(batch.column(2), self.dims))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *batch.columns], ["cell", *batch.schema.names])

    def queries(self, batches: Iterator, first_only: bool) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches, 256):
            least, most = self.tree.scores(matrix(batch.column(2), self.dims))
            low, high = batch.column(3), batch.column(4)
            of = np.repeat(np.arange(batch.num_rows), low.value_lengths().to_numpy(zero_copy_only=False))
            lo, hi = (c.flatten().to_numpy(zero_copy_only=False) for c in (low, high))
            meets = (most[of] >= lo[:, None]) & (least[of] <= hi[:, None])
            reach = np.where(meets, np.minimum(most[of], hi[:, None]), -np.inf)
            wanted = np.zeros((batch.num_rows, len(self.tree.leaves)), bool)
            if first_only:
                has = np.flatnonzero(meets.any(axis=1))
                wanted[of[has], reach[has].argmax(axis=1)] = True
            else:
                np.logical_or.at(wanted, of, meets)
            row, cell = np.nonzero(wanted)
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *taken.columns], ["cell", *batch.schema.names])


class _First:
    def __init__(self, cells: _Cells, first_only: bool):
        self.cells, self.first_only = cells, first_only

    def __call__(self, batches: Iterator) -> Iterator:
        return self.cells.queries(batches, self.first_only)


def _visit(most: float, dims: int, k: int, same: bool, leaf_rows: int):
    """What a task makes of one shard of a cell and some of the queries that meet it."""

    def visit(rows, queries):
        import pyarrow as pa

        def column(table, name: str):
            return pa.concat_arrays(table.column(name).chunks)

        def numbers(table, name: str) -> np.ndarray:
            return column(table, name).to_numpy(zero_copy_only=False)

        out = [np.zeros(0, np.int64)] * 4
        if rows.num_rows and queries.num_rows:
            x, q = matrix(column(rows, "v"), dims), matrix(column(queries, "v"), dims)
            tree = Tree(x, most, leaf_rows, True)
            low, high = column(queries, "low"), column(queries, "high")
            size = low.value_lengths().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(size)), size)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            low, high = (c.flatten().to_numpy(zero_copy_only=False) for c in (low, high))
            w, i, s = nearest(tree, x, numbers(rows, "vec_id"), numbers(rows, "label"), q, numbers(queries, "label"), of, low, high, k, same)
            out = [numbers(queries, "g")[of[w]], nth[w], i, s]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(z, kind) for z, kind in zip(out, kinds, strict=True)], ["g", "w", "id", "score"])

    return visit


class Index:
    """All rows(vec_id, label, v) dealt into cells; `search` gives exact results."""

    def __init__(self, rows: DataFrame, cell_rows: int = CELL_ROWS, query_rows: int = QUERY_ROWS, leaf_rows: int = LEAF_ROWS):
        self.query_rows, self.leaf_rows = query_rows, leaf_rows
        square = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
        n, most, dims = rows.agg(F.count("*"), F.max(square), F.max(F.size("v"))).first()
        self.empty, self.most, self.dims = not n, float(most or 0), max(1, dims or 0)
        if self.empty:
            return
        ship(rows.sparkSession)
        cells = min(MAX_CELLS, 1 << max(0, (int(n) - 1) // cell_rows).bit_length())
        sample = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS * cells).collect() if cells > 1 else []
        x = np.zeros((max(1, len(sample)), self.dims))
        for i, r in enumerate(sample):
            x[i, : len(r.v)] = r.v
        self.cells = _Cells(Tree(x, self.most, SAMPLE_ROWS if cells > 1 else 1, False), self.dims)
        self.rows = written(map_arrow(rows.select("vec_id", "label", "v"), self.cells.rows, "cell int, vec_id long, label long, v array<int>"), "mining-cells")
        # One row a cell, MAX_CELLS at most.
        self.shards = F.broadcast(self.rows.groupBy("cell").count().select("cell", F.ceil(F.col("count") / cell_rows).cast("int").alias("shards")))

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """`queries(g, label, v, low, high)`, g being unique and low and high arrays of windows: `g, w, id, score`, for window
        w up to k rows with the highest scores in it, ties by smaller id.
        """
        queries = written(queries.select("g", "label", "v", "low", "high"), "mining-queries")
        blocks = max(1, -(-queries.count() // self.query_rows))
        seeds = self._round(queries, k, same, blocks, True)
        seeds = seeds.groupBy("g", "w").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") == k)
        seeds = seeds.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("w", "s"))).alias("seed"))  # an entry a window
        raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("seed", i.cast("int")), x)))
        narrowed = queries.join(seeds, "g", "left").select("g", "label", "v", F.when(F.col("seed").isNull(), F.col("low")).otherwise(raised).alias("low"), "high")
        return self._round(written(narrowed, "mining-narrowed"), k, same, blocks, False)

    def _round(self, queries: DataFrame, k: int, same: bool, blocks: int, first_only: bool) -> DataFrame:
        asked = map_arrow(queries, _First(self.cells, first_only), "cell int, g long, label long, v array<int>, low array<long>, high array<long>")
        asked = written(asked.withColumn("block", F.pmod(F.xxhash64("g"), F.lit(blocks)).cast("int")), "mining-asked")
        shard = F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int")
        rows = self.rows.join(self.shards, "cell").withColumn("shard", shard)
        if first_only:
            rows, asked_of = rows.where("shard = 0"), asked.withColumn("shard", F.lit(0))
        else:
            asked_of = asked.join(self.shards, "cell").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
        wanted = asked.groupBy("cell").agg(F.collect_set("block").alias("blocks"))  # a row a cell
        rows = rows.join(F.broadcast(wanted), "cell").select("cell", "shard", F.explode("blocks").alias("block"), "vec_id", "label", "v")
        key = ["cell", "shard", "block"]
        found = rows.groupBy(*key).cogroup(asked_of.groupBy(*key)).applyInArrow(_visit(self.most, self.dims, k, same, self.leaf_rows), "g long, w int, id long, score long")
        ranked = found.withColumn("_r", F.row_number().over(Window.partitionBy("g", "w").orderBy(F.col("score").desc(), "id")))
        return ranked.where(F.col("_r") <= k).drop("_r")


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, **sizes: int) -> DataFrame:
    """Hard negatives of the rows(vec_id, label, v: array<int>) for which `anchor` holds: `anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score`.

    A row's score is its inner product with the anchor; the highest come first, ties by smaller vec_id. Positives are the first
    rows of the anchor's label other than itself; negatives the first rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. Components that a vector lacks count as zero, so an
    empty vector is the zero vector. Rows without vec_id, label or v take no part; rows that repeat a vec_id are one, that of
    the least label and vector. Anchors without a positive or negative have no row, nor has an empty table. Other columns are
    ignored. Rows of equal label and vector are searched once, whatever their number.
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "v").where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    unique = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    unique = written(unique, "mining-rows")
    # Of equal rows only the least ids can come first; map tasks keep no more than these of each.
    own = Window.partitionBy("label", "v").orderBy("vec_id")
    kept = unique.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= max(positives + 1, negatives)).drop("_r")
    index = Index(kept, **sizes)
    anchors = unique.where(anchor)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if index.empty:
        return rows.sparkSession.createDataFrame([], schema)
    groups = written(anchors.groupBy("label", "v").agg(F.min("vec_id").alias("g")), "mining-groups")
    everywhere = lambda x: F.array(F.lit(x).cast("long"))
    best = index.search(groups.select("g", "label", "v", everywhere(-FAR).alias("low"), everywhere(FAR).alias("high")), positives + 1, True)
    # Of each group the first rows, itself among them: at most positives + 1.
    ranked = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), lambda r: F.struct(r["id"].alias("id"), (-r["s"]).alias("score")))
    best = written(best.groupBy("g").agg(ranked.alias("pos"), F.sort_array(F.collect_set("score")).alias("scores")), "mining-positives")
    bounds = best.select("g", F.filter("scores", lambda s: s >= 0).alias("scores")).join(groups, "g")  # below zero every window is empty
    window = lambda term: F.expr(f"transform(scores, s -> ({term}) div 100)")
    bounds = written(bounds.select("g", "label", "v", window(f"s * {low} + 99").alias("low"), window(f"s * {high}").alias("high"), "scores"), "mining-windows")
    found = index.search(bounds.where("size(low) > 0"), negatives, False)
    packed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), lambda r: F.struct(r["id"].alias("id"), (-r["s"]).alias("score")))
    found = found.groupBy("g", "w").agg(packed.alias("neg")).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("w", "neg"))).alias("neg"))
    result = best.select("g", "pos").join(bounds.select("g", "scores"), "g").join(found, "g").join(groups, "g")
    per = anchors.select(F.col("vec_id").alias("anchor_id"), "label", "v").join(result, ["label", "v"])
    chosen = F.slice(F.filter("pos", lambda p: p["id"] != F.col("anchor_id")), 1, positives)
    per = per.select("anchor_id", "neg", "scores", F.explode(chosen).alias("p"))
    nth = (F.array_position("scores", F.col("p.score")) - 1).cast("int")
    per = per.select("anchor_id", "p", F.posexplode(F.try_element_at("neg", nth)).alias("nth", "n"))
    return per.select(
        "anchor_id", F.col("p.id").alias("positive_id"), (F.col("nth") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"),
    )


#: The query over DuckDB: all pairs of an anchor and a row.
SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM r AS a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank,
  s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) <= 3
"""
