"""Top-K search: exact, for one query or many, and quantized with exact rescoring.

Points are (id, vector array<double>, any payload columns). Results are ordered by score, highest first, then by id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.config import Distance
from pointloom.functions import quantize
from pointloom.functions.distance import normalized, score, strict_score


def _prepared(vector: Column, metric: Distance) -> Column:
    return normalized(vector) if metric == Distance.COSINE else vector


def _asked(query: Column, metric: Distance) -> Column:
    """The query's vector, prepared; a task that meets one without direction, or not finite, raises an error."""
    bad = query.isNull() | F.exists(query, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if metric == Distance.COSINE:
        bad |= ~F.exists(query, lambda x: x != 0)
    return F.when(bad, F.raise_error(F.lit("a query needs a finite vector, not zero for cosine")).cast("array<double>")).otherwise(_prepared(query, metric))


def _scored(vector: Column, query: Column, value: Column) -> Column:
    """value, unless the dimensions differ: that raises an error. A point without a vector has no score."""
    differ = F.raise_error(F.concat(F.lit("a query of another dimension: "), F.size(query).cast("string"))).cast("double")
    return F.when(F.size(vector) != F.size(query), differ).otherwise(value)


def scored(points: DataFrame, query: DataFrame, metric: Distance, strict: bool = False) -> DataFrame:
    """points with `score` against the one row of `query`, its column q. For cosine, points are to be stored normalized."""
    q = query.limit(1).select(_asked(F.col("q"), metric).alias("q"))
    both = points.crossJoin(F.broadcast(q))
    value = strict_score(metric)("vector", "q") if strict else score(F.col("vector"), F.col("q"), metric)
    return both.withColumn("score", _scored(F.col("vector"), F.col("q"), value)).drop("q")


def top_k(points: DataFrame, query: DataFrame, k: int, metric: Distance = Distance.DOT, where: Column | None = None, threshold: float | None = None, strict: bool = False) -> DataFrame:
    """The k nearest points that satisfy `where`, of score >= threshold. Filters run before scores. Points without a
    vector are left out; a query of another dimension, not finite, or zero for cosine fails."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if threshold is not None and not math.isfinite(threshold):
        raise ValueError("threshold must be finite")
    found = scored(points if where is None else points.where(where), query, metric, strict)
    if threshold is not None:
        found = found.where(F.col("score") >= threshold)
    return found.where(F.col("score").isNotNull()).orderBy(F.desc("score"), "id").limit(k)


def batch_top_k(points: DataFrame, queries: DataFrame, k: int, metric: Distance = Distance.DOT) -> DataFrame:
    """For each row (query_id, q) of queries: rank, id and score of its k nearest other points. A pair of rows costs a few
    additions in a product of blocks, but ten microseconds in interpreted functions, so all queries go through blocks."""
    return knn_join(points, queries, k, metric)


def _decoded(codes: Column) -> Column:
    return quantize.decode(codes, F.col("minima"), F.col("scales"))


def top_k_by_codes(coded: DataFrame, query: DataFrame, k: int, metric: Distance = Distance.DOT) -> DataFrame:
    """The k nearest of coded (id, codes, minima, scales, any more columns), by `about`: the score between decoded codes and
    the query, coded and decoded by the same ranges."""
    q = query.limit(1).select(_asked(F.col("q"), metric).alias("q"))
    both = coded.crossJoin(F.broadcast(q))  # one row
    of_query = _decoded(quantize.encode(F.col("q"), F.col("minima"), F.col("scales")))
    about = _scored(F.col("codes"), F.col("q"), score(_decoded(F.col("codes")), of_query, metric))
    return both.withColumn("about", about).where(F.col("about").isNotNull()).drop("q").orderBy(F.desc("about"), "id").limit(k)


def quantized_top_k(points: DataFrame, query: DataFrame, k: int, metric: Distance = Distance.DOT, oversampling: int = 4, where: Column | None = None) -> DataFrame:
    """The k best by exact score among the k * oversampling best by decoded codes, of points that have no stored codes:
    ranges are fitted and codes made on the way. Queries and points are checked as in top_k."""
    if k < 1 or oversampling < 1:
        raise ValueError("k and oversampling must be at least 1")
    coded = points.where(F.col("vector").isNotNull()).crossJoin(F.broadcast(quantize.fit(points)))  # one row
    coded = coded.withColumn("codes", quantize.encode(F.col("vector"), F.col("minima"), F.col("scales")))
    near = top_k_by_codes(coded if where is None else coded.where(where), query, k * oversampling, metric)
    return top_k(near.drop("codes", "minima", "scales", "about"), query, k, metric)


def retrieve(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """points of wanted's ids (pos, id), in the order of pos, ids that repeat included, others skipped."""
    return wanted.join(points, "id").orderBy("pos")


#: Rows of one side that a task of the blocked join holds, about.
BLOCK_ROWS = 4096


def knn_join(points: DataFrame, queries: DataFrame, k: int, metric: Distance = Distance.DOT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, id, score of the k nearest points (id, vector) to each row of queries (query_id, q), whose own id is
    left out; both sides of any size.

    Rows of both sides are dealt into blocks of about block_rows, and every pair of blocks is a task's work: a matrix
    product finds what may be among the k best of the pair, and these are scored in the order of their components, so that
    equal vectors tie. What is shuffled is each side as often as the other has blocks, and k rows a query and block.
    Null ids and vectors, on either side, take no part; a vector of another dimension is an error, and so is a query that
    is not finite, or zero for cosine (where points are to be stored normalized).
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    asked = queries.where(F.col("query_id").isNotNull() & F.col("q").isNotNull()).select("query_id", _asked(F.col("q"), metric).alias("q"))
    held = points.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).select("id", "vector")
    blocks = [max(1, -(-df.count() // block_rows)) for df in (held, asked)]
    place = lambda column, of, salt: F.pmod(F.xxhash64(F.lit(salt), column), F.lit(blocks[of])).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(blocks[of] - 1)))
    left = held.select(place("id", 0, 1).alias("p"), every(1).alias("b"), "id", "vector")
    right = asked.select(every(0).alias("p"), place("query_id", 1, 2).alias("b"), "query_id", "q")
    found = left.groupBy("p", "b").cogroup(right.groupBy("p", "b")).applyInArrow(_block_pair(k, metric), "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    sizes = np.diff(flat.offsets.to_numpy())
    if len(np.unique(sizes)) > 1:
        raise ValueError(f"vectors of several dimensions: {np.unique(sizes).tolist()}")
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1)


def _block_pair(k: int, metric: Distance):
    def nearest(points: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if points.num_rows and queries.num_rows:
            v, q = _matrix(points["vector"]), _matrix(queries["q"])
            if v.shape[1] != q.shape[1]:
                raise ValueError(f"a query of another dimension: {q.shape[1]}")
            ids = points["id"].to_numpy()
            about = q @ v.T
            if metric == Distance.EUCLID:
                about = 2 * about - (v * v).sum(1) - (q * q).sum(1)[:, None]
            # The product's rounding error is below this, so whoever is among the k best passes.
            slack = 1e-9 * (1 + np.abs(v).max(initial=0) ** 2 * v.shape[1] + np.abs(q).max(initial=0) ** 2 * v.shape[1])
            for i, query_id in enumerate(queries["query_id"].to_pylist()):
                row = np.where(ids == query_id, -np.inf, about[i])
                least = np.partition(row, -k)[-k] if k < len(row) else -np.inf
                near = np.flatnonzero((row >= least - slack) & (row > -np.inf))
                exact = np.add.accumulate(-((v[near] - q[i]) ** 2) if metric == Distance.EUCLID else v[near] * q[i], axis=1)[:, -1]
                best = np.lexsort((ids[near], -exact))[:k]
                for column, values in zip(out, ([query_id] * len(best), ids[near][best].tolist(), exact[best].tolist()), strict=True):
                    column += values
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "id", "score"), out, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    return nearest
