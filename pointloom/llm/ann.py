"""Operator 1: approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample (`SAMPLE` rows, those of the lowest id hashes); every row is then put into its
leaf. A query opens nodes in the order of a priority queue, nearest centre first, and so visits leaves. How many it
visits is widened until, for `CALIBRATION` sampled vectors whose true neighbours are known from all rows, the wanted
share of these lies in the leaves visited. The first of them give each query a bound, its k-th distance so far, and the
others only return what is within it. Rows of a leaf and the queries that visit it meet in blocks of bounded size,
however full a leaf or popular a place is.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm.common import cut, table

NEAREST = 10
SAMPLE = 20_000
CALIBRATION = 200
RECALL = 0.95
BRANCHES = 16
#: Leaves are meant to hold the square root of the number of rows, this many at least.
LEAF_ROWS = 100
#: This part of the visits comes first, to find the bounds.
FIRST = 8
BLOCK = 4096


@dataclass(frozen=True)
class Tree:
    """centres[i] is node i's; children[i] its nodes, none for a leaf; leaf[i] its number, -1 for other nodes. Node 0 is the root."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray
    leaves: int

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down the nearest centres."""
        out, todo = np.zeros(len(vectors), np.int32), [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            below = self.children[node]
            if not len(below):
                out[rows] = self.leaf[node]
                continue
            near = _squares(vectors[rows], self.centres[below]).argmin(1)
            todo += [(child, rows[near == k]) for k, child in enumerate(below) if (near == k).any()]
        return out

    def best_first(self, vector: np.ndarray) -> Iterator[int]:
        """Leaves in the order of their centres' distances, of the nodes opened so far."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            below = self.children[node]
            if not len(below):
                yield int(self.leaf[node])
            else:
                gap = ((self.centres[below] - vector) ** 2).sum(1)
                for pair in zip(gap.tolist(), below.tolist(), strict=True):
                    heapq.heappush(queue, pair)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)


def fit_tree(sample: np.ndarray, leaf_size: int, branches: int = BRANCHES, rounds: int = 8) -> Tree:
    random = np.random.default_rng(7)
    centres, children, leaf, leaves = [sample.mean(0) if len(sample) else np.zeros(sample.shape[1])], [np.empty(0, np.int64)], [-1], 0
    todo = [(0, sample)]
    while todo:
        node, rows = todo.pop()
        distinct = np.unique(rows, axis=0) if len(rows) > leaf_size else rows[:1]
        if len(rows) <= leaf_size or len(distinct) < 2:
            leaf[node], leaves = leaves, leaves + 1
            continue
        means = distinct[random.permutation(len(distinct))[: min(branches, len(distinct))]]
        for _ in range(rounds):
            near = _squares(rows, means).argmin(1)
            means = np.stack([rows[near == k].mean(0) for k in range(len(means)) if (near == k).any()])
        near = _squares(rows, means).argmin(1)
        parts = [k for k in range(len(means)) if (near == k).any()]
        if len(parts) < 2:
            leaf[node], leaves = leaves, leaves + 1
            continue
        children[node] = np.arange(len(centres), len(centres) + len(parts))
        for k in parts:
            todo.append((len(centres), rows[near == k]))
            centres.append(means[k])
            children.append(np.empty(0, np.int64))
            leaf.append(-1)
    return Tree(np.stack(centres), children, np.array(leaf, np.int32), leaves)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, int]:
    """(vec_id, v) of rows with an id and a finite, non-zero vector of the commonest dimension (the smallest of equally common), and that dimension; 0 without rows."""
    v = F.col(vector_column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = vectors.where(F.col(id_column).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).select(F.col(id_column).alias("vec_id"), v.alias("v"))
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dimension = sizes[0]["d"] if sizes else 0
    return good.where(F.size("v") == dimension), dimension


def _top(near: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("square", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest_of(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, bounds: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """For each query the k rows nearest to it, other than those of its own id, by exact squares of differences; within its bound, if there are bounds."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, (q, vector) in enumerate(zip(query_ids, queries, strict=True)):
        square = ((rows - vector) ** 2).sum(1)
        square[ids == q] = np.inf
        most = np.partition(square, min(k, len(square)) - 1)[min(k, len(square)) - 1]
        at = np.nonzero(square <= (most if bounds is None else min(most, bounds[i])))[0]
        at = at[np.isfinite(square[at])]
        at = at[np.lexsort((ids[at], square[at]))][:k]
        found.append((np.full(len(at), q), ids[at], square[at]))
    return {name: np.concatenate([f[i] for f in found]) for i, name in enumerate(("query_id", "vec_id", "square"))}


NEAR = "query_id long, vec_id long, square double"


def exact_nearest(rows: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int, dimension: int) -> DataFrame:
    """The k nearest of all rows (vec_id, v, any more) to each of a bounded number of queries."""
    sent = rows.sparkSession.sparkContext.broadcast((query_ids, queries))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(_nearest_of(batch["vec_id"].to_numpy(), _matrix(batch["v"], dimension), *sent.value, k))

    return _top(rows.select("vec_id", "v").mapInArrow(search, NEAR), k)


def _visits(tree: Tree, sizes: np.ndarray, vector: np.ndarray, width: int, least: int) -> list[int]:
    """The first `width` leaves, and on until they hold `least` rows."""
    out, rows = [], 0
    for leaf in tree.best_first(vector):
        if len(out) >= width and rows >= least:
            break
        out.append(leaf)
        rows += sizes[leaf]
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, recall: float = RECALL, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: up to k rows of `vectors` for each row of `queries`, a part of the same table.

    score is the Euclidean distance in double precision; nearest first, ties to the smaller id. Rows of the query's own
    id are left out. Rows whose id is null, or whose vector is null, empty, zero, of another dimension or with a null or
    non-finite component, take no part. Of queries with one id, the smallest vector counts. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows, dimension = usable(vectors, id_column, vector_column)
    asked, _ = usable(queries, id_column, vector_column)
    if not dimension:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = asked.where(F.size("v") == dimension).groupBy("vec_id").agg(F.min("v").alias("v"))
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE + CALIBRATION).toPandas()
    points = np.stack(sample["v"].to_numpy()).astype(np.float64)
    # The tree is fitted on others than it is calibrated with, unless there are too few.
    fitted = points[CALIBRATION if len(points) > 2 * CALIBRATION else 0 :]
    tree = fit_tree(fitted, max(8, max(LEAF_ROWS, math.isqrt(total)) * len(fitted) // total))
    sent = spark.sparkContext.broadcast(tree)

    @F.arrow_udf("int")
    def leaf_of(v: pa.Array) -> pa.Array:
        return pa.array(sent.value.assign(_matrix(v, dimension)))

    placed = cut(rows.withColumn("leaf", leaf_of("v")))
    sizes = np.zeros(tree.leaves, np.int64)
    for row in placed.groupBy("leaf").count().collect():  # as many as leaves, which the sample bounds
        sizes[row["leaf"]] = row["count"]

    few = sample.iloc[:CALIBRATION]
    true = exact_nearest(placed, few["vec_id"].to_numpy(), points[: len(few)], k, dimension)
    homes = true.join(placed.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").toPandas()
    order = {q: {leaf: i for i, leaf in enumerate(tree.best_first(p))} for q, p in zip(few["vec_id"], points, strict=False)}
    needed = np.sort([order[q][leaf] + 1 for q, leaf in zip(homes["query_id"], homes["leaf"], strict=True)])
    width = 1
    while width < tree.leaves and np.searchsorted(needed, width, "right") < recall * len(needed):
        width += 1
    facts = spark.sparkContext.broadcast(sizes)

    @F.arrow_udf("array<int>")
    def visited(v: pa.Array) -> pa.Array:
        return pa.array([_visits(sent.value, facts.value, q, width, k + 1) for q in _matrix(v, dimension)], pa.list_(pa.int32()))

    visits = cut(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), visited("v").alias("leaves")))
    first = -(-width // FIRST)
    near = cut(_top(_meet(placed, visits.withColumns({"leaves": F.slice("leaves", 1, first), "bound": F.lit(math.inf)}), sizes, k, dimension), k))
    bounds = near.where(F.col("rank") == k).select("query_id", F.col("square").alias("bound"))
    rest = visits.join(bounds, "query_id", "left").select("query_id", "q", F.expr(f"slice(leaves, {first + 1}, size(leaves))").alias("leaves"), F.coalesce("bound", F.lit(math.inf)).alias("bound"))
    both = near.drop("rank").unionByName(_meet(placed, rest, sizes, k, dimension))
    return _top(both, k).select("query_id", F.col("rank").cast("int"), "vec_id", F.sqrt("square").alias("score"))


def _meet(placed: DataFrame, visits: DataFrame, sizes: np.ndarray, k: int, dimension: int) -> DataFrame:
    """For every query (query_id, q, leaves, bound) the k nearest of each block of the leaves it visits, within its bound."""
    visits = visits.select("query_id", "q", "bound", F.explode("leaves").alias("leaf"))
    popular = visits.groupBy("leaf").agg(F.count("*").alias("asked"))
    held = placed.sparkSession.createDataFrame(pd.DataFrame({"leaf": np.arange(len(sizes), dtype=np.int32), "held": sizes}), "leaf int, held long")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int").alias(f"{n}_parts")
    parts = F.broadcast(held.join(popular, "leaf").where("held > 0").select("leaf", blocks("held"), blocks("asked")))  # one row a leaf
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    left = placed.join(parts, "leaf").select("leaf", own("vec_id", "held_parts").alias("r"), spread("asked_parts").alias("s"), "vec_id", "v")
    right = visits.join(parts, "leaf").select("leaf", spread("held_parts").alias("r"), own("query_id", "asked_parts").alias("s"), "query_id", "q", "bound")

    def meet(one: pa.Table, other: pa.Table) -> pa.Table:
        if not one.num_rows or not other.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "square": pa.array([], pa.float64())})
        a, b = one.combine_chunks().to_batches()[0], other.combine_chunks().to_batches()[0]
        asked = b["query_id"].to_numpy(), _matrix(b["q"], dimension)
        return pa.table(_nearest_of(a["vec_id"].to_numpy(), _matrix(a["v"], dimension), *asked, k, b["bound"].to_numpy()))

    key = ["leaf", "r", "s"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, NEAR)


def op1_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))
