import json
import random

from pyspark.sql import Observation
from pyspark.sql import functions as F

from pointloom import ids
from pointloom.config import Distance, PayloadSchema, ScalarQuantizationConfig
from pointloom.operators import payload_index
from pointloom.operators.filters import Filter, HasId, Match, Range, compile_filter, compile_typed, matches_filter
from pointloom.sources.collection import Collection

LEAVES = [0, 1, 2, 2**53, 2**53 + 1, -(2**53) - 1, 2**63 - 1, 2**63, 10**30, 1.0, 2.5, 1e300, -1e300, True, False, None, "1", "x", "", [1, 2], [], [2**53 + 1, "x"], {"b": 1}, [None], [[1], 2.5]]
VALUES = [0, 1, 2, 2**53, 2**53 + 1, 2**63, -(2**63), 10**30, 10**40, 10**400, 1.0, 2.5, 1e300, True, False, None, "1", "x", ""]


def conditions(r, depth=2):
    path = r.choice(["a", "a", "c", "a.b"])
    kind = r.randrange(4 if depth else 2)
    if kind == 0:
        return Match(path, r.choice(VALUES))
    if kind == 1:
        low, high = sorted(r.choice([0, 1, 2.5, 2**53, 2**53 + 1, 1e300, -(2.0**70), 10**39, -(10**400)]) for _ in range(2))
        return Range(path, **r.choice([{"gt": low}, {"gte": low, "lt": high}, {"lte": high}, {"gt": low, "lte": high}]))
    part = lambda n: [conditions(r, depth - 1) for _ in range(r.randrange(n))]
    return Filter(must=part(3), should=part(3), must_not=part(2))


def test_an_index_never_changes_a_filter(spark):
    """Over random payloads of mixed leaves and random conditions: what the stored columns rule out does not satisfy them."""
    r = random.Random(11)
    payloads = [{k: x for k in ("a", "c") if (x := r.choice([*LEAVES, ...])) is not ...} for _ in range(150)]
    rows = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)], "id long, json string").withColumn("p", F.parse_json("json"))
    for schema in PayloadSchema:
        columns = {}
        for path in ("a", "c"):
            value, other = payload_index.stored(F.col("p"), path, schema)
            columns |= {f"v_{path}": value, f"o_{path}": other}
        indexes = {p: payload_index.Indexed(f"v_{p}", f"o_{p}", schema) for p in ("a", "c")}
        asked = [conditions(r) for _ in range(60)]
        held = rows.withColumns(columns).cache()
        may = [payload_index.candidates(c, indexes) for c in asked]
        found = held.select("id", *(F.coalesce(F.lit(True) if m is None else m, F.lit(False)).alias(f"m{k}") for k, m in enumerate(may)), *(compile_filter(c, F.col("p"), F.lit("")).alias(f"f{k}") for k, c in enumerate(asked))).collect()
        for row in found:
            for k, c in enumerate(asked):
                holds = matches_filter(c, row["id"], payloads[row["id"]])
                assert row[f"f{k}"] == holds, (c, payloads[row["id"]])
                assert row[f"m{k}"] or not holds, (schema, c, payloads[row["id"]])
        assert any(not row[f"m{k}"] for row in found for k in range(60))
        for k, c in enumerate(asked[:12]):
            bounds = payload_index.cardinality(held, c, indexes).first()
            n = sum(row[f"f{k}"] for row in found)
            assert bounds["minimum"] <= n <= bounds["maximum"] and (not bounds["exact"] or bounds["minimum"] == n), (schema, c)
        held.unpersist()


def test_keys_of_any_characters(spark):
    payloads = [{"it's \"so\"": 1}, {"it's": 2, "a'b": {'c"d': 3}}, {}]
    rows = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)], "id long, json string").withColumn("p", F.parse_json("json"))
    for c in (Match("it's \"so\"", 1), Match("it's", 2), Match("a'b.c\"d", 3)):
        assert [r["id"] for r in rows.where(compile_filter(c, F.col("p"), F.lit(""))).collect()] == [i for i, p in enumerate(payloads) if matches_filter(c, i, p)]


def stored(spark, path, **more):
    rows = [(i, [float(i % 17), float(i % 5)], json.dumps({"kind": i % 50, "tag": f"t{i % 3}"})) for i in range(2000)]
    c = Collection.create(spark, str(path), dimension=2, distance=Distance.DOT, **more)
    c.create_payload_index("kind", PayloadSchema.INTEGER)
    c.upsert(spark.createDataFrame(rows, "id long, vector array<double>, payload string"))
    return c, spark.createDataFrame([([1.0, 0.5],)], "q array<double>")


def test_a_search_reads_what_the_index_lets_through(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        c, q = stored(spark, tmp_path / "c")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    condition, facts = Filter(must=[Match("kind", 7), Match("tag", "t1")]), Observation()
    found = c.search(q, 5, condition, facts=facts)
    plan = found._jdf.queryExecution().executedPlan()
    assert "PushedFilters" in plan.toString() and "EqualTo(__pidx_0,7)" in plan.toString()
    got = [(r["id"], r["score"]) for r in found.collect()]
    score = lambda i: float(i % 17) + 0.5 * (i % 5)
    assert got == sorted(((i, score(i)) for i in range(2000) if i % 50 == 7 and i % 3 == 1), key=lambda x: (-x[1], x[0]))[:5]
    assert facts.get == {"let_through": 40, "scored": sum(i % 50 == 7 and i % 3 == 1 for i in range(2000))}
    read = c._live("payload", where=payload_index.candidates(condition, c._indexed()))
    read.write.format("noop").mode("overwrite").save()
    scan = [n for n in _nodes(read._jdf.queryExecution().executedPlan()) if "FileScan" in n.toString().split("\n")[0] or "Scan" in n.nodeName()]
    read.collect()
    rows = [n.metrics().apply("numOutputRows").value() for n in scan if n.metrics().contains("numOutputRows")]
    assert rows and 0 < rows[0] < 2000
    # An index made later, writes after it, and a reopened collection.
    c.upsert(spark.createDataFrame([(7, [9.0, 9.0], '{"kind":"7"}'), (5000, [99.0, 0.0], '{"kind":7,"tag":"t1"}')], "id long, vector array<double>, payload string"))
    c.delete(spark.createDataFrame([(57,)], "id long"))
    c.create_payload_index("tag", PayloadSchema.KEYWORD)
    c = Collection.open(spark, c.path)
    now = {r["id"] for r in c.search(q, 5000, condition).collect()}
    assert now == {i for i in range(2000) if i % 50 == 7 and i % 3 == 1 and i not in (7, 57)} | {5000}


def _nodes(plan):
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    found = [plan]
    for i in range(plan.children().size()):
        found += _nodes(plan.children().apply(i))
    return found


def test_the_first_phase_reads_codes_only(spark, tmp_path, monkeypatch):
    c, q = stored(spark, tmp_path / "c", quantization=ScalarQuantizationConfig(2))
    c.upsert(spark.createDataFrame([(3, [50.0, 1.0], "{}"), (9000, [40.0, 0.0], "{}")], "id long, vector array<double>, payload string"))
    c.delete(spark.createDataFrame([(4,)], "id long"))
    monkeypatch.setattr("pointloom.functions.quantize.fit", None)  # nothing is fitted when a query comes
    first = c.nearest_codes(q, 10)
    plan = first._jdf.queryExecution().executedPlan().toString()
    schemas = [line.split("ReadSchema: ")[1] for line in plan.split("\n") if "ReadSchema" in line]
    assert any("codes" in s for s in schemas) and not any("vector" in s or "payload" in s for s in schemas)
    got = [(r["id"], r["score"]) for r in c.search(q, 3).collect()]
    exact = [(r["id"], r["score"]) for r in c.search(q, 3, exact=True).collect()]
    assert got == exact and got[0] == (3, 50.5) and got[1] == (9000, 40.0)


KIND = "struct<a:struct<b:int,s:string,f:double,t:boolean>,list:array<struct<n:int,tags:array<string>>>,v:variant>"
TYPED = [
    {"a": {"b": 1, "s": "x", "f": 2.5, "t": True}, "list": [{"n": 4, "tags": ["p", "q"]}, {"n": 9, "tags": []}], "v": {"deep": [1, "z"]}},
    {"a": {"b": None, "s": "", "f": 1.0, "t": False}, "list": [], "v": {"deep": None}},
    {"a": {"b": -7, "s": "1", "f": -0.0, "t": True}, "list": [{"n": 1, "tags": ["q"]}], "v": {}},
]


def test_typed_payloads(spark):
    tree = Filter(must=[Match("list.tags", "q")], must_not=[Range("a.b", lt=0)], should=[Match("v.deep", "z"), Match("a.s", "1")])
    asked = [Match("a.b", 1), Match("a.b", 1.5), Match("a.b", True), Match("a.b", None), Match("a.b", 2**40), Match("a.s", "1"), Match("a.s", 1), Match("a.f", 2.5), Match("a.f", 1), Match("a.t", 1), Match("a.t", False), Match("list.n", 4), Match("list.tags", "q"), Match("v.deep", 1), Match("no.such", 1), Match("a", 1), Range("a.b", gt=0.5), Range("a.b", gte=-(2**40), lt=1), Range("a.b", lte=10**400), Range("a.f", gt=-1, lt=2.5), Range("list.n", gt=4), Range("a.s", gt=0), HasId([0, 2]), Filter(), tree]
    rows = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(TYPED)], "id long, json string")
    typed = rows.select("id", F.from_json("json", KIND.replace(",v:variant", "")).alias("s"), F.parse_json(F.get_json_object("json", "$.v")).alias("v"))
    typed = typed.select("id", F.struct("s.*", "v").alias("p"))
    for c in asked:
        holds = compile_typed(c, F.col("p"), typed.schema["p"].dataType, ids.key_of_integers(F.col("id")))
        assert [r["id"] for r in typed.where(holds).orderBy("id").collect()] == [i for i, p in enumerate(TYPED) if matches_filter(c, i, p)], c


def test_typed_filters_go_down_to_parquet(spark, tmp_path):
    rows = spark.createDataFrame([(json.dumps(p),) for p in TYPED], "json string").select(F.from_json("json", KIND.replace(",v:variant", "")).alias("p"))
    rows.write.parquet(str(tmp_path / "t"))
    p = spark.read.parquet(str(tmp_path / "t"))
    plan = p.where(compile_typed(Filter(must=[Range("a.b", gte=1), Match("a.s", "x")]), F.col("p"), p.schema["p"].dataType, F.lit(""))).select("p.a.f")._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "GreaterThanOrEqual(p.a.b,1)" in plan and "EqualTo(p.a.s,x)" in plan and "list" not in schema and "t:boolean" not in schema


def test_type_profile(spark):
    rows = [{"a": 1}, {"a": [2, "x"]}, {"a": None}, {"a": {"b": 1.5}}, {}, {"c": [True, False]}]
    p = spark.createDataFrame([(json.dumps(x),) for x in rows], "json string").select(F.parse_json("json").alias("p"))
    got = {r["path"]: r.asDict() for r in payload_index.type_profile(p, "p", ["a", "a.b", "c", "none"]).collect()}
    assert got["a"] == {"path": "a", "leaves": 5, "strings": 1, "integers": 2, "numbers": 0, "booleans": 0, "nulls": 1, "objects": 1, "homogeneous": False}
    assert got["a.b"]["numbers"] == 1 and got["a.b"]["homogeneous"] and got["c"]["booleans"] == 2 and got["none"]["leaves"] == 0
