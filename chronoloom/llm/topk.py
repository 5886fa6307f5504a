"""Exact top-k search by inner product with dual cover trees.

The trees' upper levels are Spark's, the lower ones a task's:

1. Pivots are picked farthest first from a bounded sample of the candidates, so they
   lie apart and cover it. Every candidate and every query goes to its nearest pivot:
   a cell is a ball with a covering radius, which an aggregate finds.
2. First pass: the queries of a cell meet the candidates of the same cell (a block of
   them, if it is large). That gives each query a k-th score, and each cell of queries
   its worst one.
3. A cell of queries visits only those cells of candidates for which the largest inner
   product that the two covering radii allow reaches its worst k-th score. Their number
   is bounded by ``CELLS`` squared, so the driver decides that from centers and radii.
4. Second pass: in a task a cover tree is built over a block of queries and one over a
   block of candidates, and both are walked together: a pair of nodes is dropped when its
   bound is below the worst k-th score of the query node's members, and in a pair of
   leaves each query by the bound of its own.

The result is exact whatever is pruned. Where vectors are spread evenly over many
dimensions all balls are as large as the whole and no bound of this kind prunes; then all
queries meet all candidates, in blocks.

Of equal vectors only the k + 1 smallest ids can be among the k best (one may be the
query's own), so a vector shared by very many rows is a few rows here. Blocks have a
bounded number of bytes, so memory is bounded as the table grows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.llm.common import map_batches, materialize

#: Rows of a leaf, children of a node, cells, and rows of the sample that the pivots are picked from, at most.
LEAF, FAN, CELLS, SAMPLE = 128, 16, 1024, 8192
#: Bytes of a cell of candidates on average, of a block of candidates and of a block of queries, about.
CELL_BYTES, BLOCK_BYTES, QUERY_BYTES = 2 << 20, 8 << 20, 4 << 20
_LEAST, _MOST = -(2**63), 2**63 - 1


class Node:
    """A ball: ``center`` with covering ``radius``, and its children or rows."""

    __slots__ = ("center", "children", "norm", "radius", "rows")

    def __init__(self, points: np.ndarray, rows: np.ndarray):
        own = points[rows]
        self.rows, self.children = rows, []
        self.center = own.mean(0)
        self.norm = float(np.sqrt(self.center @ self.center))
        far = float(np.sqrt(((own - self.center) ** 2).sum(1).max()))
        self.radius = far + 1e-9 * (far + self.norm)


def farthest_first(points: np.ndarray, most: int, within: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(chosen rows, which of them is nearest to each row): each next one is the
    farthest from those before, until all rows lie ``within`` or ``most`` are chosen."""
    away, of = np.full(len(points), np.inf), np.zeros(len(points), int)
    chosen: list[int] = []
    pick = int(((points - points.mean(0)) ** 2).sum(1).argmax())
    while len(chosen) < most and away[pick] > within**2:
        d = ((points - points[pick]) ** 2).sum(1)
        near = d < away
        of[near], away[near] = len(chosen), d[near]
        chosen.append(pick)
        pick = int(away.argmax())
    return np.array(chosen), of


def cover_tree(points: np.ndarray) -> Node:
    """A node's children are balls around centers that lie more than half its radius
    apart and cover its rows within that half, or as well as ``FAN`` of them can."""
    root = Node(points, np.arange(len(points)))
    stack = [root]
    while stack:
        node = stack.pop()
        if len(node.rows) <= LEAF:
            continue
        _, of = farthest_first(points[node.rows], FAN, node.radius / 2)
        sizes = np.bincount(of)
        if len(sizes) > 1:
            node.children = [Node(points, part) for part in np.split(node.rows[np.argsort(of, kind="stable")], np.cumsum(sizes)[:-1])]
            stack += node.children
    return root


def bound(dot, a_norm, a_radius, b_norm, b_radius):
    """No inner product of two balls' members is larger; rounding is allowed for."""
    most = dot + a_radius * b_norm + b_radius * a_norm + a_radius * b_radius
    return np.maximum(most + 1e-9 * (a_norm + a_radius) * (b_norm + b_radius) + 1e-6, float(_LEAST))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly; the nearest long beyond longs."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, _LEAST, _MOST).astype(np.int64)


def search(queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, point row, score, pairs that were scored): every point that may be
    among a query's ``k`` best, with each query's k best of these points unless they are
    below its floor. A point with the query's own id is no candidate."""
    if not len(queries) or not len(points):
        none = np.empty(0, np.int64)
        return none, none, none, 0
    q, p = queries.astype(float), points.astype(float)
    norms = np.sqrt((q**2).sum(1))
    best, kth = np.full((len(q), k), _LEAST), floors.copy()
    found, scored = [], 0
    a, b = cover_tree(q), cover_tree(p)
    over = lambda a, b: float(bound(a.center @ b.center, a.norm, a.radius, b.norm, b.radius))
    stack = [(over(a, b), a, b)]
    while stack:
        most, a, b = stack.pop()
        if most < kth[a.rows].min():
            continue
        if b.children and (not a.children or b.radius >= a.radius):
            stack += sorted(((over(a, c), a, c) for c in b.children), key=lambda x: x[0])
        elif a.children:
            stack += [(over(c, b), c, b) for c in a.children]
        else:
            rows = a.rows[bound(q[a.rows] @ b.center, norms[a.rows], 0.0, b.norm, b.radius) >= kth[a.rows]]
            if not len(rows):
                continue
            scores = products(queries[rows], points[b.rows])
            scored += scores.size
            ok = (scores >= kth[rows][:, None]) & (ids[b.rows] != query_ids[rows][:, None])
            i, j = np.nonzero(ok)
            found.append((rows[i], b.rows[j], scores[i, j]))
            both = np.concatenate([best[rows], np.where(ok, scores, _LEAST)], 1)
            best[rows] = np.partition(both, -k, 1)[:, -k:]
            kth[rows] = np.maximum(kth[rows], best[rows].min(1))
    row, point, score = (np.concatenate([x[c] for x in found]) if found else np.empty(0, np.int64) for c in range(3))
    still = score >= kth[row]
    return row[still], point[still], score[still], scored


def _rank(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's ``k`` best, ties to the smaller id; an id counts ``times``."""
    order = np.repeat(np.lexsort((ids, ~scores, row)), times[np.lexsort((ids, ~scores, row))])
    row, ids, scores = row[order], ids[order], scores[order]
    best = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[best], ids[best], scores[best]


def _matrix(column, width: int = 0) -> np.ndarray:
    """Lists as rows, zeros behind the shorter ones."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), max(width, int(lengths.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
    return out


def whole_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(id, v)`` with v = floor(scale * x), x as double; rows with a null id, a
    null vector or a null or non-finite component are left out. Components that no
    long holds count as the nearest long."""
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(9.2e18)), F.lit(-9.2e18))))
    bad = F.exists(F.col(vector_col).cast("array<double>"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return table.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("id"), x.cast("array<long>").alias("v"))


def placed(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vectors`` with the nearest pivot, ``cell``, and the distance from it, ``away``."""
    names = vectors.columns

    def run(batches):
        norms = (pivots**2).sum(1)
        for batch in batches:
            v = _matrix(batch.column(names.index("v")), pivots.shape[1]).astype(float)
            p = np.pad(pivots, ((0, 0), (0, v.shape[1] - pivots.shape[1])))
            cell = (norms - 2 * (v @ p.T)).argmin(1) if len(v) else np.empty(0, int)
            away = np.sqrt(((v - p[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)], [*names, "cell", "away"])

    return vectors.transform(map_batches, run, vectors.select("*").schema.add("cell", "integer").add("away", "double"))


def visits(pivots: np.ndarray, query_radius: np.ndarray, worst: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Which cells of candidates (columns) each cell of queries (rows) must visit;
    a radius below 0 marks an empty cell."""
    norms = np.sqrt((pivots**2).sum(1))
    some = (query_radius >= 0)[:, None] & (radius >= 0)
    most = bound(pivots @ pivots.T, norms[:, None], np.maximum(query_radius, 0)[:, None], norms, np.maximum(radius, 0))
    return some & (most >= worst[:, None])


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` best candidates by
    integer inner product, all if fewer, ties to the smaller id.

    A candidate with the query's own id takes no part. Of vectors of different
    length the missing components count as 0. Rows with equal ids are candidates
    each; equal queries are one, and different queries with equal id share one
    list. No rows on either side give no rows. Scores beyond a long are the
    nearest long. Further columns are ignored.
    """
    spark = queries.sparkSession
    q = materialize(whole_vectors(queries, id_col, vector_col, scale).distinct(), "queries")
    c = whole_vectors(candidates, id_col, vector_col, scale).groupBy("id", "v").agg(F.least(F.count("*"), F.lit(k)).alias("times"))
    c = c.withColumn("nth", F.dense_rank().over(W.partitionBy("v").orderBy("id"))).where(F.col("nth") <= k + 1).drop("nth")
    c = materialize(c, "candidates")
    n, width = c.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n or q.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    row = 8 * max(width, 1)
    cells = max(1, min(CELLS, n * row // CELL_BYTES))
    sample = _matrix(c.select("v").orderBy(F.xxhash64("v")).limit(min(SAMPLE, 8 * cells)).toArrow()["v"], width).astype(float)
    pivots = sample[farthest_first(sample, cells)[0]]
    cells = len(pivots)

    q, c = materialize(placed(q, pivots), "placed-queries"), materialize(placed(c, pivots), "placed")
    radius, size = _balls(c, cells)
    query_radius, query_size = _balls(q, cells)
    blocks = np.maximum(1, -(-size * row // BLOCK_BYTES))
    query_blocks = np.maximum(1, -(-query_size * row // QUERY_BYTES))
    by_cell = lambda x: F.lit(x.tolist())[F.col("cell")]  # noqa: E731  (at most CELLS numbers)
    salt = lambda n: F.pmod(F.xxhash64("id", "v"), n).cast("int")
    c = c.withColumn("salt", salt(by_cell(blocks)))
    q = q.withColumn("part", salt(by_cell(query_blocks)))

    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    none = F.lit(_LEAST).alias("floor")
    first = _meet(
        q.select("cell", F.lit(0).alias("salt"), F.col("cell").alias("part1"), F.col("part").alias("part2"), none, "id", "v", F.lit(0).cast("long").alias("times")),
        c.where("salt = 0").select("cell", "salt", F.col("cell").alias("part1"), every(by_cell(query_blocks)).alias("part2"), none, "id", "v", "times"),
        k,
    )
    first = materialize(first, "first")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    q = materialize(q.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(_LEAST))), "floors")
    worst = np.zeros(cells)
    for at, least in q.groupBy("cell").agg(F.min("floor")).collect():  # at most CELLS rows
        worst[at] = least

    go = visits(pivots, query_radius, worst, radius)
    # Small cells of queries share a block, so that candidates are sent to few of them.
    group, held = np.zeros(cells, int), 0
    for i in range(cells):
        held += query_size[i] * row
        group[i] = group[i - 1] + (held > QUERY_BYTES) if i else 0
        held = query_size[i] * row if held > QUERY_BYTES else held
    asked = np.zeros((group[-1] + 1, cells), bool)
    np.logical_or.at(asked, group, go)
    parts = np.ones(group[-1] + 1, int)
    np.maximum.at(parts, group, query_blocks)
    cell_type = "cell int, to array<int>"
    of_query = spark.createDataFrame([(i, np.flatnonzero(go[i]).tolist()) for i in range(cells)], cell_type)
    of_cell = spark.createDataFrame([(i, np.flatnonzero(asked[:, i]).tolist()) for i in range(cells)], cell_type)
    home = (F.col("to") == F.col("cell")) & (F.col("salt") == 0)  # met already
    sent = q.join(F.broadcast(of_query), "cell").select("cell", F.lit(group.tolist())[F.col("cell")].cast("int").alias("part1"), F.col("part").alias("part2"), F.explode("to").alias("to"), "floor", "id", "v")
    sent = sent.withColumn("salt", every(F.lit(blocks.tolist())[F.col("to")])).where(~home)
    kept = c.join(F.broadcast(of_cell), "cell").select("cell", "salt", F.explode("to").alias("part1"), none, "id", "v", "times")
    kept = kept.withColumn("part2", every(F.lit(parts.tolist())[F.col("part1")]))
    second = _meet(
        sent.select(F.col("to").alias("cell"), F.col("salt").cast("int").alias("salt"), "part1", "part2", "floor", "id", "v", F.lit(0).cast("long").alias("times")),
        kept.select("cell", "salt", "part1", F.col("part2").cast("int").alias("part2"), "floor", "id", "v", "times"),
        k,
    )
    met = first.unionByName(second)
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _balls(vectors: DataFrame, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(radius, rows) of each cell; an empty one has radius -1."""
    radius, size = np.full(cells, -1.0), np.zeros(cells, np.int64)
    for cell, away, rows in vectors.groupBy("cell").agg(F.max("away"), F.count("*")).collect():  # at most CELLS rows
        radius[cell], size[cell] = away * (1 + 1e-9) + 1e-9, rows
    return radius, size


def _meet(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """``(query_id, vec_id, score)``: what may be among the k best of each query, by
    blocks: queries (``times`` 0) meet the candidates of the same cell, salt and part."""

    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        times, ids, v = part["times"].to_numpy(), part["id"].to_numpy(), _matrix(part["v"])
        query, point = times == 0, times > 0
        row, at, score, _ = search(v[query], ids[query], part["floor"].to_numpy()[query], v[point], ids[point], k)
        row, found, score = _rank(row, ids[point][at], score, times[point][at], k)
        return pa.table({"query_id": ids[query][row], "vec_id": found, "score": score}, pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))

    return queries.unionByName(candidates).groupBy("cell", "salt", "part1", "part2").applyInArrow(run, "query_id long, vec_id long, score long")
