"""Exact top-k by inner product with a KD-tree for each shard.

Components become integers floor(scale * x).  Rows are dealt by hash to shards of about `shard_rows`; each shard's tree
is built once, by median splits of the widest dimension, with a tight bounding box at every node, and stored.  For a
query q, a box bounds every inner product within it by sum(max(q * low, q * high)).  A search is best first: a heap
holds open nodes by their bounds, from the root; it ends when the best bound left is below the k-th score.

The k-th score travels in two ways.  First each query is searched in its own shard only, which gives it a floor; then
blocks of `block_rows` queries with their floors meet lanes of up to `lane` shards, and along a lane each search
starts from the k-th score of the shards before.  A task holds a block and a lane whatever the sizes; each lane
returns k rows a query at most, and a ranked window merges them.

Edge cases: vectors that are null, empty or hold a null or non-finite component take no part; only vectors of equal
length compare; a query never meets its own row but does meet other rows of the same id; ties go to the smaller id,
null ids last; scores beyond 64 bits saturate (such shards are read in full); ids are whole numbers; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as c

LEAF = 256
NO_ID = np.iinfo(np.int64).max
FIELDS = ["ids", "rows", "kind", "data", "nodes", "boxes"]
PACKED = pa.schema([("dim", pa.int32()), ("part", pa.int32()), *((f, pa.string() if f == "kind" else pa.binary()) for f in FIELDS)])
FOUND = "q_row long, query_id long, score long, vec_id long, c_row long"


class Tree:
    """A KD-tree: rows in leaf order, and nodes (first row, end, left child, right child; -1 at a leaf) with their boxes."""

    def __init__(self, points, ids, rows, nodes, low, high):
        self.points, self.ids, self.rows, self.nodes, self.low, self.high = points, ids, rows, nodes, low, high

    @classmethod
    def build(cls, points: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> "Tree":
        order = np.arange(len(points))
        nodes, low, high = [], [], []
        stack = [(0, len(points), -1, 0)]
        while stack:
            first, end, parent, side = stack.pop()
            own = points[order[first:end]]
            low.append(own.min(0)), high.append(own.max(0)), nodes.append([first, end, -1, -1])
            if parent >= 0:
                nodes[parent][side] = len(nodes) - 1
            if end - first > LEAF:
                middle = (end - first) // 2
                cut = np.argpartition(own[:, int(np.argmax(high[-1] - low[-1]))], middle)
                order[first:end] = order[first:end][cut]
                stack += [(first, first + middle, len(nodes) - 1, 2), (first + middle, end, len(nodes) - 1, 3)]
        return cls(points[order], ids[order], rows[order], np.array(nodes, np.int64), np.array(low), np.array(high))

    def packed(self) -> dict:
        """Its columns; components in the smallest type that holds them all."""
        kind = next((k for k in ("i1", "i2", "i4") if (self.points == self.points.astype(k)).all()), "f8")
        boxes = np.stack([self.low, self.high]).astype(kind)
        return dict(zip(FIELDS, (self.ids.tobytes(), self.rows.tobytes(), kind, self.points.astype(kind).tobytes(), self.nodes.tobytes(), boxes.tobytes())))

    @classmethod
    def load(cls, dim: int, ids, rows, kind, data, nodes, boxes) -> "Tree":
        low, high = np.frombuffer(boxes, kind).reshape(2, -1, dim).astype(np.float64)
        return cls(np.frombuffer(data, kind).reshape(-1, dim).astype(np.float64), np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64), np.frombuffer(nodes, np.int64).reshape(-1, 4), low, high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def _scores(points: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while they cannot round, else in Python's integers."""
    if len(q) * np.abs(points).max(initial=0) * np.abs(q).max(initial=0) < 2.0**53:
        return (points @ q).astype(np.int64)
    whole = [int(x) for x in q.tolist()]
    exact = [sum(int(a) * b for a, b in zip(p, whole)) for p in points.tolist()]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, x)) for x in exact], np.int64)


def _best(scores, ids, rows, k):
    order = np.lexsort((rows, ids, ~scores))[:k]  # ~score sorts from the highest down
    return scores[order], ids[order], rows[order]


def search(tree: Tree, queries, own_rows, best, floors, k) -> int:
    """Bring each query's (scores, ids, rows) up to date with a shard; scores below a query's floor do not matter.
    Returns the number of leaves opened."""
    most = queries.shape[1] * np.abs(tree.points).max(initial=0) * np.abs(queries).max(initial=0)
    bounds = tree.bounds(queries) if most < 2.0**53 else np.full((len(queries), len(tree.nodes)), np.inf)  # exact, or none
    nodes, opened = tree.nodes.tolist(), 0
    for i, q in enumerate(queries):
        own = bounds[i].tolist()
        kth = max(floors[i], best[i][0][-1] if len(best[i][0]) == k else -np.inf)
        heap = [(-own[0], 0)]
        while heap:
            bound, at = heapq.heappop(heap)
            if -bound < kth:
                break
            first, end, left, right = nodes[at]
            if left >= 0:
                for child in (left, right):
                    if own[child] >= kth:
                        heapq.heappush(heap, (-own[child], child))
                continue
            opened += 1
            scores = _scores(tree.points[first:end], q)
            keep = scores >= kth
            if not keep.any():
                continue
            keep &= tree.rows[first:end] != own_rows[i]
            index = np.flatnonzero(keep) + first
            best[i] = _best(np.append(best[i][0], scores[keep]), np.append(best[i][1], tree.ids[index]), np.append(best[i][2], tree.rows[index]), k)
            if len(best[i][0]) == k:
                kth = max(kth, best[i][0][-1])
    return opened


def _columns(table):
    ids = table.column("id").combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = table.column("row").to_numpy().astype(np.int64)
    data = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return ids, rows, data


def _plant(key, table):
    """A shard's rows as one row that holds its tree."""
    ids, rows, data = _columns(table)
    tree = Tree.build(data.reshape(len(ids), -1), ids, rows)
    return pa.Table.from_pylist([{"dim": key[0].as_py(), "part": key[1].as_py(), **tree.packed()}], schema=PACKED)


def _found(q_ids, q_rows, best):
    count = [len(b[0]) for b in best]
    cat = lambda i: np.concatenate([b[i] for b in best]) if best else np.empty(0, np.int64)
    ids = cat(1)
    return pa.table({"q_row": np.repeat(q_rows, count), "query_id": np.repeat(q_ids, count), "score": cat(0), "vec_id": pa.array(ids, mask=ids == NO_ID), "c_row": cat(2)})


def _search(k: int):
    """Queries (left) against trees (right), the shards one after the other."""

    def run(key, asked, shards):
        q_ids, q_rows, data = _columns(asked)
        none = np.empty(0, np.int64)
        best = [(none, none, none)] * len(q_ids)
        if len(q_ids):
            queries = data.reshape(len(q_ids), -1)
            floors = asked.column("floor").to_pandas().astype(float).fillna(-np.inf).to_numpy()
            floors = np.nextafter(floors, -np.inf)  # a score beyond 2 ** 53 has no exact double
            for row in sorted(shards.select(["part", *FIELDS]).to_pylist(), key=lambda r: r["part"]):
                search(Tree.load(queries.shape[1], *(row[f] for f in FIELDS)), queries, q_rows, best, floors, k)
        c.release()
        return _found(q_ids, q_rows, best)

    return run


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256, every: int = 50, shard_rows: int = 8192, block_rows: int = 16384, lane: int = 8) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id `every` divides, the k highest scores among all other rows."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    base = vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).where(fine)
    base = base.select(F.col(id_col).cast("long").alias("id"), x.alias("x"), F.monotonically_increasing_id().alias("row"))
    whole = F.transform("x", lambda e: F.when(F.abs(e) < 2.0**44, F.floor(e * float(scale)).cast("double")).otherwise(e * float(scale)))
    base = c.materialize(base.select("id", "row", whole.alias("v"), F.size("x").alias("dim")), "vectors")
    total, asking = c.bounded_batches(base).agg(F.count("*"), F.count_if(F.pmod("id", F.lit(every)) == 0)).first()
    shards, blocks = max(1, -(-total // shard_rows)), max(1, -(-asking // block_rows))
    wide = max(1, min(lane, shards * blocks // (2 * base.sparkSession.sparkContext.defaultParallelism)))  # shards of a lane
    part = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    base = base.withColumn("part", part(shards))
    trees = base.groupBy("dim", "part").applyInArrow(_plant, "dim int, part int, " + ", ".join(f"{f} {'string' if f == 'kind' else 'binary'}" for f in FIELDS))
    trees = c.materialize(trees, "trees")
    asked = base.where(F.pmod("id", F.lit(every)) == 0)

    # floors: the k-th score of each query within its own shard
    home = asked.withColumn("floor", F.lit(None).cast("long")).groupBy("dim", "part").cogroup(trees.groupBy("dim", "part")).applyInArrow(_search(k), FOUND)
    floor = home.groupBy("q_row").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k).select(F.col("q_row").alias("row"), "floor")
    asked = c.materialize(asked.join(floor, "row", "left"), "asked")

    asked = asked.withColumn("block", part(blocks)).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit((shards - 1) // wide))))
    trees = trees.withColumn("lane", F.floor(F.col("part") / wide).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    by = ["dim", "block", "lane"]
    found = asked.groupBy(*by).cogroup(trees.groupBy(*by)).applyInArrow(_search(k), FOUND)
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "c_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
