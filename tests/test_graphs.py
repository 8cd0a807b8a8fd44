import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.config import Distance, HnswConfig
from pointloom.operators import hnsw, search


def unit_vectors(n, d, seed=3):
    v = np.random.default_rng(seed).standard_normal((n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def table(spark, vectors):
    return spark.createDataFrame(list(enumerate(vectors.tolist())), "id long, vector array<double>")


@pytest.mark.parametrize("metric", [Distance.DOT, Distance.EUCLID])
def test_walks_widen_until_they_find_none_better(spark, metric):
    """In many dimensions the first breadth reaches too little of a graph."""
    v = unit_vectors(3000, 48)
    p = table(spark, v)
    q = p.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
    graph = hnsw.build(p, metric, HnswConfig(m=6, ef_construct=16), segment_points=1500).cache()
    got: dict[int, set[int]] = {}
    for r in hnsw.search(graph, q, 11, metric, ef=11).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    exact = np.argsort(-(v[::50] @ v.T), axis=1)[:, :11]
    hits = [len(got[50 * k] & set(best.tolist())) for k, best in enumerate(exact)]
    assert all(len(x) == 11 for x in got.values()) and sum(hits) >= 0.85 * 11 * len(hits)


def test_copies_and_parts_out_of_reach(spark):
    v = np.repeat(unit_vectors(12, 4), 40, axis=0)  # groups of copies, each without a way out in layer 0
    q = spark.createDataFrame([(1000, v[85].tolist())], "query_id long, q array<double>")
    graph = hnsw.build(table(spark, v), config=HnswConfig(m=4, ef_construct=8)).cache()
    assert [r["id"] for r in hnsw.search(graph, q, 480, ef=1 << 30).orderBy("rank").collect()] == np.lexsort((np.arange(480), -(v @ v[85]).round(9))).tolist()
    allowed = table(spark, v).where("id >= 473")
    assert sorted(r["id"] for r in hnsw.search(graph, q, 10, ef=10, allowed=allowed).collect()) == list(range(473, 480))


def test_graph_takes_any_number_of_queries(spark):
    v = unit_vectors(30, 3)
    q = spark.range(10_500).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("q"))
    found = hnsw.search(hnsw.build(table(spark, v)).cache(), q, 2, ef=30)
    assert {(r["rank"], r["id"], r["n"]) for r in found.groupBy("rank", "id").agg(F.count("*").alias("n")).collect()} == {(k + 1, int(i), 10_500) for k, i in enumerate(np.argsort(-v[:, 0])[:2])}


def test_batch_of_queries_goes_through_blocks(spark):
    p = table(spark, unit_vectors(60, 3))
    found = search.batch_top_k(p, p.where("id < 5").select(F.col("id").alias("query_id"), F.col("vector").alias("q")), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and found.count() == 15


def test_neighbours_are_found_in_little_memory():
    v = unit_vectors(6000, 8)
    tracemalloc.start()
    hnsw.layer_neighbours(v, Distance.DOT, 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
