import json

import pytest
from pyspark.sql import functions as F

from pointloom import cli
from pointloom.config import Distance, PayloadSchema, ScalarQuantizationConfig
from pointloom.errors import ClosedResourceError, CollectionExistsError, CollectionNotFoundError, CorruptionError, InvalidPointError, InvalidVectorError, PayloadIndexError, SnapshotError
from pointloom.operators.filters import HasId, Match, Range
from pointloom.sources.collection import Collection
from pointloom.streaming.operations import OPERATIONS, apply_operations

ROWS = "id long, vector array<double>, payload string"


def made(spark, path, rows, **more):
    c = Collection.create(spark, str(path), dimension=2, distance=more.pop("distance", Distance.DOT), **more)
    c.upsert(spark.createDataFrame(rows, ROWS))
    return c


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def query(spark, *v):
    return spark.createDataFrame([([float(x) for x in v],)], "q array<double>")


def state(c):
    return {r["id"]: json.loads(r["p"]) for r in c.points().select("id", F.to_json("payload").alias("p")).collect()}


def test_versions_patches_and_reopening(spark, tmp_path):
    c = made(spark, tmp_path / "c", [(1, [1.0, 0.0], '{"size":1,"old":2}'), (2, [0.0, 1.0], None)])
    assert c.upsert(spark.createDataFrame([(2, [0.5, 0.5], '{"shade":"blue"}')], ROWS)) == 2
    assert c.merge_payload(ids(spark, 1), '{"lit":true}') == 3
    assert c.delete_payload_keys(ids(spark, 1, 77), ["old"]) == 4
    assert c.replace_payload(ids(spark, 99), "{}") is None and c.manifest["version"] == 4
    assert c.delete(ids(spark, 99)) == 5
    c = Collection.open(spark, c.path)
    assert state(c) == {1: {"size": 1, "lit": True}, 2: {"shade": "blue"}}
    c.optimize()
    assert state(c) == {1: {"size": 1, "lit": True}, 2: {"shade": "blue"}} and len(c.manifest["batches"]) == 1
    assert c.vacuum() > 0 and c.count() == 2
    c.delete(ids(spark, 1))
    assert [r["id"] for r in c.search(query(spark, 1, 0), 5).collect()] == [2]


def test_a_bad_batch_changes_nothing(spark, tmp_path):
    c = made(spark, tmp_path / "c", [(1, [1.0, 0.0], "{}")])
    for rows, error in (([(2, [1.0], "{}"), (3, [1.0, 1.0], "{}")], InvalidVectorError), ([(2, [1.0, float("nan")], "{}")], InvalidVectorError), ([(None, [1.0, 1.0], "{}")], InvalidPointError), ([(2, [1.0, 1.0], "[1]")], InvalidPointError)):
        with pytest.raises(error):
            c.upsert(spark.createDataFrame(rows, ROWS))
    assert c.count() == 1 and c.manifest["version"] == 1


def test_first_row_of_a_batch_counts(spark, tmp_path):
    c = Collection.create(spark, str(tmp_path / "c"), dimension=1, distance=Distance.DOT)
    c.upsert(spark.createDataFrame([(1, [1.0], '{"n":"second"}', 1), (1, [2.0], '{"n":"first"}', 0)], ROWS + ", ordinal int"))
    assert state(c) == {1: {"n": "first"}}


def test_search_filters_cosine_and_quantized(spark, tmp_path):
    rows = [(4, [3.0, 0.1], '{"hue":"teal"}'), (5, [2.0, 1.0], '{"hue":"rust"}'), (6, [1.0, 1.1], '{"hue":"teal"}')]
    c = made(spark, tmp_path / "c", rows, distance=Distance.COSINE, quantization=ScalarQuantizationConfig())
    assert [r["id"] for r in c.search(query(spark, 2, 0), 2, Match("hue", "teal")).collect()] == [4, 6]
    assert [r["id"] for r in c.search(query(spark, 1, 0), 2, exact=True).collect()] == [4, 5]
    with pytest.raises(InvalidVectorError):
        c.upsert(spark.createDataFrame([(7, [0.0, 0.0], "{}")], ROWS))
    for bad in ((1,), (0, 0), (1, float("inf"))):
        with pytest.raises(InvalidVectorError):
            c.search(query(spark, *bad), 2)
    c.create_payload_index("hue", PayloadSchema.KEYWORD)
    assert Collection.open(spark, c.path).indexed_points().where("__pidx_0 = 'teal' AND NOT __pother_0").count() == 2
    assert c.search(query(spark, 1, 0), 9, Range("hue", gt=1)).count() == 0


def test_a_search_keeps_its_batches(spark, tmp_path):
    c = made(spark, tmp_path / "c", [(1, [1.0, 0.0], "{}")])
    before = c.points()
    c.delete(ids(spark, 1))
    c.optimize()
    assert before.count() == 1 and c.count() == 0


def test_writes_during_optimize_stay(spark, tmp_path, monkeypatch):
    c = made(spark, tmp_path / "c", [(1, [1.0, 0.0], "{}"), (2, [1.0, 0.0], "{}")])
    real = Collection._live

    def live(self, *columns, **more):  # while the batches are read, another writer publishes
        monkeypatch.setattr(Collection, "_live", real)
        other = Collection.open(spark, c.path)
        other.delete(ids(spark, 1))
        other.upsert(spark.createDataFrame([(3, [0.0, 1.0], "{}")], ROWS))
        return real(self, *columns, **more)

    monkeypatch.setattr(Collection, "_live", live)
    c.optimize()
    assert set(state(c)) == {2, 3} and len(c.manifest["batches"]) == 3 and c.manifest["version"] == 3
    c.optimize()
    assert set(state(c)) == {2, 3} and len(c.manifest["batches"]) == 1


def test_snapshots_and_names(spark, tmp_path):
    c = made(spark, tmp_path / "c", [(1, [1.0, 0.0], '{"x":1}')])
    snap = c.create_snapshot(str(tmp_path / "snap"))
    c.delete(ids(spark, 1))
    assert state(Collection.restore(spark, snap, str(tmp_path / "back"))) == {1: {"x": 1}}
    for call, error in ((lambda: c.create_snapshot(snap), SnapshotError), (lambda: Collection.restore(spark, str(tmp_path / "none"), "x"), SnapshotError), (lambda: Collection.open(spark, str(tmp_path / "none")), CollectionNotFoundError), (lambda: Collection.create(spark, c.path, dimension=2, distance=Distance.DOT), CollectionExistsError)):
        with pytest.raises(error):
            call()
    empty = Collection.create(spark, str(tmp_path / "empty"), dimension=2, distance=Distance.DOT)
    assert empty.count() == 0 and empty.search(query(spark, 1, 0), 3).count() == 0


def test_stream_of_operations(spark, tmp_path):
    c = Collection.create(spark, str(tmp_path / "c"), dimension=1, distance=Distance.DOT)
    ops = [(0, "upsert", 1, [1.0], "{}"), (1, "upsert", 2, [2.0], "{}"), (2, "delete", 1, None, None), (3, "upsert", 1, [3.0], '{"again":1}'), (4, "delete", 2, None, None), (5, "delete", 9, None, None)]
    spark.createDataFrame(ops, OPERATIONS).write.parquet(str(tmp_path / "ops"))
    stream = lambda: apply_operations(spark.readStream.schema(OPERATIONS).parquet(str(tmp_path / "ops")), c, str(tmp_path / "state")).awaitTermination()
    stream()
    assert state(c) == {1: {"again": 1}} and c.manifest["version"] == 1
    batch = spark.createDataFrame([(0, "delete", 1, None, None)], OPERATIONS)
    assert c.apply(batch, source=str(tmp_path / "state"), epoch=0) is None and c.count() == 1  # as if run again after a failure
    assert c.apply(batch, source=str(tmp_path / "state"), epoch=1) == 2 and c.count() == 0
    for bad in ((0, "other", 1, None, None), (0, "delete", None, None, None)):
        with pytest.raises(InvalidPointError):
            c.apply(spark.createDataFrame([bad], OPERATIONS))
    assert c.apply(spark.createDataFrame([], OPERATIONS)) is None


BIG, U1, U2 = 2**64 - 1, "00000000-0000-0000-0000-00000000000a", "ffffffff-1234-5678-1234-567812345678"


def test_unsigned_and_uuid_ids(spark, tmp_path):
    """Ids of both kinds in one collection, in any usual form: integers first among ties, one point an id."""
    c = Collection.create(spark, str(tmp_path / "c"), dimension=1, distance=Distance.DOT, ids="any")
    text = "id string, vector array<double>, payload string"
    c.upsert(spark.createDataFrame([(str(BIG), [1.0], '{"n":1}'), (U2.upper(), [1.0], '{"n":2}'), ("7", [1.0], '{"n":3}'), (f"{{{U1}}}", [1.0], '{"n":4}'), ("10", [1.0], None)], text))
    c.upsert(spark.createDataFrame([(f"urn:uuid:{U2}", [1.0], '{"n":5}'), ("007", [1.0], '{"n":6}')], text))
    c.merge_payload(spark.createDataFrame([(U1.replace("-", ""),)], "id string"), '{"more":true}')
    c.delete(spark.createDataFrame([(10,)], "id long"))
    assert [r["id"] for r in c.search(query(spark, 1), 9).collect()] == ["7", str(BIG), U1, U2]
    assert {r["id"]: json.loads(r["p"]) for r in c.points().select("id", F.to_json("payload").alias("p")).collect()} == {"7": {"n": 6}, str(BIG): {"n": 1}, U1: {"n": 4, "more": True}, U2: {"n": 5}}
    assert [r["id"] for r in c.search(query(spark, 1), 9, HasId([U2, BIG])).collect()] == [str(BIG), U2]
    assert [r["id"] for r in c.retrieve(spark.createDataFrame([(0, U2), (1, "7"), (2, "8")], "pos int, id string")).collect()] == [U2, "7"]
    for bad in (str(2**64), "-1", "", "x", "1.5", None, U1[:-1]):
        with pytest.raises(InvalidPointError):
            c.upsert(spark.createDataFrame([(bad, [1.0], "{}")], text))
    again = Collection.restore(spark, c.create_snapshot(str(tmp_path / "s")), str(tmp_path / "d"))
    again.optimize()
    assert again.count() == 4 and again.rows().where(F.col("id") == str(BIG)).count() == 1


def test_what_a_search_returns_and_errors(spark, tmp_path):
    c = made(spark, tmp_path / "c", [(1, [1.0, 0.0], "{}")])
    assert c.search(query(spark, 1, 0), 1).columns == ["id", "version", "score", "payload"]
    assert c.search(query(spark, 1, 0), 1, with_payload=False, with_vector=True).columns == ["id", "version", "score", "vector"]
    c.create_payload_index("a", PayloadSchema.INTEGER)
    c.create_payload_index("a", "integer")
    for path, kind in (("a", "keyword"), ("bad..path", "keyword"), ("b", "date")):
        with pytest.raises(PayloadIndexError):
            c.create_payload_index(path, kind)
    c.close()
    with pytest.raises(ClosedResourceError):
        c.count()
    (tmp_path / "c" / "manifest.json").write_text("{}")
    with pytest.raises(CorruptionError):
        Collection.open(spark, c.path).count()
    (tmp_path / "c" / "collection.json").write_text("{")
    with pytest.raises(CorruptionError):
        Collection.open(spark, c.path)


def test_command_line(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"id":1,"vector":[1,0],"payload":{"name":"one"}}\n\n{"id":2,"vector":[0,1]}\n')
    at = [str(tmp_path / "db"), "c"]
    cli.run(spark, ["create", *at, "--dimension", "2"])
    assert cli.run(spark, ["upsert", *at, str(tmp_path / "p.jsonl")])["accepted"] == 2
    hits = cli.run(spark, ["search", *at, "[1, 0]", "--limit", "1"])["hits"]
    assert hits == [{"id": 1, "score": 1.0, "payload": {"name": "one"}}]
    assert cli.run(spark, ["search", *at, "[1, 0]", "--limit", "1", "--with-vector"])["hits"][0]["vector"] == [1.0, 0.0]
    cli.run(spark, ["payload-index", *at, "name", "keyword"])
    cli.run(spark, ["optimize", *at])
    assert cli.run(spark, ["info", *at])["count"] == 2
    cli.run(spark, ["snapshot", *at, str(tmp_path / "s")])
    cli.run(spark, ["delete", *at, "1"])
    with pytest.raises(CollectionExistsError):
        cli.run(spark, ["restore", str(tmp_path / "s"), *at])
    assert cli.run(spark, ["restore", str(tmp_path / "s"), *at, "--replace"]) == {"restored": "c", "count": 2}
    assert cli.run(spark, ["list", at[0]]) == {"collections": ["c"]}
    cli.run(spark, ["drop", *at])
    cli.run(spark, ["create", *at, "--dimension", "1", "--ids", "any", "--quantized"])
    (tmp_path / "q.jsonl").write_text(f'{{"id":{BIG},"vector":[1]}}\n{{"id":"{U1}","vector":[2]}}\n')
    cli.run(spark, ["upsert", *at, str(tmp_path / "q.jsonl")])
    cli.run(spark, ["delete", *at, U1])
    assert [h["id"] for h in cli.run(spark, ["search", *at, "[1]"])["hits"]] == [str(BIG)]
