import math
import random

import pytest
from pyspark.sql import functions as F

from pointloom.config import Distance, HnswConfig
from pointloom.functions import quantize
from pointloom.functions.distance import exact_sum
from pointloom.operators import hnsw, search, versions


def points(spark, vectors):
    return spark.createDataFrame([(i, v and [float(x) for x in v]) for i, v in vectors], "id long, vector array<double>")


def query(spark, v):
    return spark.createDataFrame([([float(x) for x in v],)], "q array<double>")


def test_exact_order_ties_and_threshold(spark):
    p = points(spark, [(3, [1, 0]), (1, [1, 0]), (2, [0.5, 0]), (4, [-1, 0])])
    found = search.top_k(p, query(spark, [1, 0]), 3).collect()
    assert [(r["id"], r["score"]) for r in found] == [(1, 1.0), (3, 1.0), (2, 0.5)]
    assert [r["id"] for r in search.top_k(p, query(spark, [1, 0]), 9, threshold=0.5).collect()] == [1, 3, 2]
    far = search.top_k(p, query(spark, [1, 0]), 4, Distance.EUCLID).collect()
    assert [(r["id"], r["score"]) for r in far] == [(1, 0.0), (3, 0.0), (2, -0.25), (4, -4.0)]
    for bad in ({"k": 0}, {"k": 1, "threshold": float("nan")}):
        with pytest.raises(ValueError):
            search.top_k(p, query(spark, [1, 0]), **bad)
    for q, metric in (([1], Distance.DOT), ([0, 0], Distance.COSINE), ([1, float("nan")], Distance.EUCLID)):
        with pytest.raises(Exception, match="a query"):
            search.top_k(p, query(spark, q), 2, metric).collect()


def test_filter_runs_before_the_scores(spark):
    p = points(spark, [(i, [i, 1]) for i in range(20)])
    plan = search.top_k(p, query(spark, [1, 0]), 3, where=F.col("id") < 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert [r["id"] for r in search.top_k(p, query(spark, [1, 0]), 3, where=F.col("id") < 5).collect()] == [4, 3, 2]


def test_quantizer(spark):
    p = points(spark, [(1, [3, -1.5, 0.25]), (2, [-8, -1.5, 11]), (3, [1, -1.5, 6]), (4, None)])
    both = p.where("vector IS NOT NULL").crossJoin(quantize.fit(p))
    code = quantize.encode(F.col("vector"), F.col("minima"), F.col("scales"))
    rows = both.select("vector", code.alias("c"), quantize.decode(code, F.col("minima"), F.col("scales")).alias("back"), quantize.error_bound(F.col("scales")).alias("bound")).collect()
    for r in rows:
        assert r["c"][1] == 0 and r["back"][1] == -1.5
        assert all(abs(x - y) <= r["bound"] + 1e-12 for x, y in zip(r["vector"], r["back"], strict=True))
    assert quantize.fit(p.where("false")).count() == 0


def test_quantized_rescore_keeps_exact_scores(spark):
    p = points(spark, [(6, [0.31, 2.5]), (7, [0.62, -1.0]), (8, [0.615, 0.75]), (9, [-2.25, 0.5]), (10, [0.05, 0.0])])
    found = search.quantized_top_k(p, query(spark, [1, 0]), 2, oversampling=2).collect()
    assert [(r["id"], r["score"]) for r in found] == [(7, 0.62), (8, 0.615)]
    for q, metric in (([1], Distance.DOT), ([0, 0], Distance.COSINE), ([1, float("nan")], Distance.EUCLID)):
        with pytest.raises(Exception, match="a query"):
            search.quantized_top_k(p, query(spark, q), 2, metric).collect()
    with pytest.raises(ValueError):
        search.quantized_top_k(p, query(spark, [1, 0]), 0)


def random_points(spark, n=200, d=8):  # fixed values: the gate's size and seed
    r = random.Random(17)
    vectors = [(i, [r.uniform(-1, 1) for _ in range(d)]) for i in range(n)]
    unit = [(i, [x / math.sqrt(sum(y * y for y in v)) for x in v]) for i, v in vectors]
    return points(spark, unit), [[r.uniform(-1, 1) for _ in range(d)] for _ in range(20)]


def test_graph_recall_and_invariants(spark):
    p, queries = random_points(spark)
    graph = hnsw.build(p, config=HnswConfig(m=12, ef_construct=64)).cache()
    rows = graph.collect()
    neighbours = {r["id"]: r["neighbours"] for r in rows}
    assert all(len(layer) <= 12 and i not in layer for i, layers in neighbours.items() for layer in layers)
    again = {r["id"]: r["neighbours"] for r in hnsw.build(p.repartition(3), config=HnswConfig(m=12, ef_construct=64)).collect()}
    assert neighbours == again
    asked = spark.createDataFrame(list(enumerate(queries, 10_000)), "query_id long, q array<double>")
    about = {(r["query_id"], r["id"]) for r in hnsw.search(graph, asked, 10).collect()}
    exact = {(r["query_id"], r["id"]) for r in search.batch_top_k(p, asked, 10).collect()}
    assert len(about & exact) >= 0.9 * len(exact)
    whole = {(r["query_id"], r["id"]) for r in hnsw.search(graph, asked, 10, ef=200).collect()}
    assert whole == exact
    even = p.where("id % 2 = 0")
    assert all(r["id"] % 2 == 0 for r in hnsw.search(graph, asked, 10, allowed=even).collect())
    few = hnsw.search(graph, asked, 10, ef=10, allowed=p.where("id % 25 = 7")).collect()  # 8 of 200: all of them, whatever the breadth
    assert len(few) == 8 * len(queries) and {r["id"] for r in few} == {r for r in range(200) if r % 25 == 7}
    near = {(r["query_id"], r["id"]) for r in hnsw.search(graph, asked, 5, ef=5, allowed=p.where("id % 7 = 0")).collect()}
    assert len(near) == 5 * len(queries)
    assert hnsw.search(graph, asked.where("false"), 3).count() == 0


def test_quantized_recall(spark):
    p, queries = random_points(spark)
    for q in queries[:5]:
        exact = {r["id"] for r in search.top_k(p, query(spark, q), 10).collect()}
        about = {r["id"] for r in search.quantized_top_k(p, query(spark, q), 10).collect()}
        assert len(exact & about) >= 9.5


@pytest.mark.parametrize("metric", list(Distance))
def test_blocked_join_equals_all_pairs(spark, metric):
    r = random.Random(3)
    vectors = [[r.uniform(-1, 1) for _ in range(5)] for _ in range(90)]
    vectors += [vectors[k] for k in range(20)] + [[1e-3] * 5]  # equal vectors tie
    p = points(spark, enumerate(vectors)).unionByName(points(spark, [(None, vectors[0]), (500, None)]))
    asked = p.where("id % 7 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
    found = search.knn_join(p, asked, 4, metric, block_rows=16)
    assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(x["query_id"], x["rank"]): (x["id"], x["score"]) for x in found.collect()}
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v] if metric == Distance.COSINE else v

    def near(v, q):
        total = 0.0
        for x, y in zip(v, q, strict=True):
            total += -((x - y) ** 2) if metric == Distance.EUCLID else x * y
        return total

    for a in range(0, len(vectors), 7):
        best = sorted((-near(v, unit(vectors[a])), b) for b, v in enumerate(vectors) if b != a)[:4]
        assert [got[a, k + 1][0] for k in range(4)] == [b for _, b in best]
        assert [got[a, k + 1][1] for k in range(4)] == pytest.approx([-s for s, _ in best], abs=1e-12)
    assert search.knn_join(p.where("false"), asked, 2).count() == 0 and search.knn_join(p, asked, 200, block_rows=50).count() == 16 * 110
    with pytest.raises(Exception, match="dimension"):
        search.knn_join(p, asked.select("query_id", F.slice("q", 1, 2).alias("q")), 2).collect()


def test_exact_sums_round_once(spark):
    r = random.Random(4)
    rows = [[r.uniform(-1, 1) * 10.0 ** r.randrange(-20, 20) for _ in range(r.randrange(12))] for _ in range(300)]
    rows += [[1e16, 1.0, -1e16], [1e308, 1e292, -1e308], [1.0, 2.0**-53, 2.0**-106], [1.0, 2.0**-53], [1.0, 2.0**-53, -(2.0**-106)], [0.1] * 10, [-1.0, -(2.0**-53), -(2.0**-80)], []]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, x array<double>")
    for k, got in df.select("k", exact_sum(F.col("x"))).collect():
        assert got == math.fsum(rows[k]), rows[k]
    p = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    q = p.where("id = 7").select(F.col("vector").alias("q"))
    found = search.scored(p, q, Distance.DOT, strict=True)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString() and "Arrow" not in found._jdf.queryExecution().executedPlan().toString()
    v7 = q.first()["q"]
    assert all(x["score"] == math.fsum(a * b for a, b in zip(x["vector"], v7, strict=True)) for x in found.collect())


def test_base_rows_are_not_shuffled(spark, tmp_path):
    rows = [(k, [float(k)], 1, 0, False) for k in range(50)]
    kind = "id long, vector array<double>, version int, ordinal int, deleted boolean"
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "base"))
    base = spark.read.parquet(str(tmp_path / "base"))
    delta = spark.createDataFrame([(3, [9.0], 2, 0, False), (3, [8.0], 2, 1, False), (4, [], 3, 0, True), (99, [1.0], 2, 0, False), (4, [7.0], 2, 0, False)], kind)
    found = versions.latest_by_delta(base, delta)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, versions.latest(base.unionByName(delta)).collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    of_base = plan[: plan.index("FileScan")]
    assert "BroadcastHashJoin" in of_base and "Exchange hashpartitioning" not in of_base
    wide = versions.latest_by_delta(base, delta, delta_rows=versions.BROADCAST_IDS + 1)
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, found.collect()))
