"""Command line: one JSON object a command.

python -m pointloom.cli create DB COLLECTION --dimension N [--distance dot] [--ids any] [--quantized] |
upsert DB COLLECTION points.jsonl | delete DB COLLECTION ID... |
search DB COLLECTION '[1, 0]' [--limit 10] [--threshold T] [--exact] [--with-vector] | optimize DB COLLECTION |
payload-index DB COLLECTION FIELD TYPE | info DB COLLECTION | snapshot DB COLLECTION TO |
restore SNAPSHOT DB COLLECTION [--replace] | list DB | drop DB COLLECTION
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.config import Distance, ScalarQuantizationConfig
from pointloom.errors import PointloomError
from pointloom.sources.collection import Collection
from pointloom.sources.database import Database


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="pointloom")
    commands = parser.add_subparsers(dest="command", required=True)
    at = ("database", "collection")
    add = lambda name, *arguments: [(c := commands.add_parser(name)), *(c.add_argument(a) for a in arguments)][0]
    create = add("create", *at)
    create.add_argument("--dimension", type=int, required=True)
    create.add_argument("--distance", type=Distance, default=Distance.COSINE)
    create.add_argument("--ids", choices=("integer", "any"), default="integer")
    create.add_argument("--quantized", action="store_true")
    add("upsert", *at, "file")
    add("delete", *at).add_argument("ids", nargs="+")
    find = add("search", *at, "vector")
    find.add_argument("--limit", type=int, default=10)
    find.add_argument("--threshold", type=float)
    find.add_argument("--exact", action="store_true")
    find.add_argument("--with-vector", action="store_true")
    add("optimize", *at)
    add("payload-index", *at, "field", "type")
    add("info", *at)
    add("snapshot", *at, "to")
    add("restore", "snapshot", *at).add_argument("--replace", action="store_true")
    add("list", "database")
    add("drop", *at)
    return parser


def read_jsonl(spark: SparkSession, path: str, ids: str = "integer") -> DataFrame:
    """One object a line: id, vector, payload (an object, {} if missing)."""
    line = F.try_parse_json("value")
    get = lambda at, kind: F.try_variant_get(line, at, kind)
    rows = spark.read.text(path).where(F.trim("value") != "")
    payload = F.coalesce(F.to_json(get("$.payload", "variant")), F.lit("{}"))
    return rows.select(get("$.id", "long" if ids == "integer" else "string").alias("id"), get("$.vector", "array<double>").alias("vector"), payload.alias("payload"))


def run(spark: SparkSession, arguments: list[str]) -> dict:
    a = _parser().parse_args(arguments)
    with Database.open(spark, a.database) as db:
        if a.command == "list":
            return {"collections": db.names()}
        if a.command == "create":
            c = db.create_collection(a.collection, dimension=a.dimension, distance=a.distance, ids=a.ids, quantization=ScalarQuantizationConfig() if a.quantized else None)
            return {"collection": a.collection, "dimension": c.config.dimension, "distance": str(c.config.distance)}
        if a.command == "restore":
            return {"restored": a.collection, "count": db.restore_collection(a.snapshot, a.collection, replace=a.replace).count()}
        if a.command == "drop":
            db.drop_collection(a.collection)
            return {"dropped": a.collection}
        return _of_collection(spark, db.collection(a.collection), a)


def _of_collection(spark: SparkSession, c: Collection, a: argparse.Namespace) -> dict:
    if a.command == "upsert":
        rows = read_jsonl(spark, a.file, c.config.ids)
        return {"accepted": rows.count(), "version": c.upsert(rows)}
    if a.command == "delete":
        kind, of = ("long", int) if c.config.ids == "integer" else ("string", str)
        return {"version": c.delete(spark.createDataFrame([(of(i),) for i in a.ids], f"id {kind}"))}
    if a.command == "search":
        query = spark.createDataFrame([([float(x) for x in json.loads(a.vector)],)], "q array<double>")
        found = c.search(query, a.limit, threshold=a.threshold, exact=a.exact, with_vector=a.with_vector)
        hits = found.withColumn("payload", F.to_json("payload")).collect()  # as many as the limit
        return {"hits": [{"id": r["id"], "score": r["score"], "payload": json.loads(r["payload"])} | ({"vector": r["vector"]} if a.with_vector else {}) for r in hits]}
    if a.command == "optimize":
        c.optimize()
        return {"generation": c.manifest["generation"]}
    if a.command == "payload-index":
        c.create_payload_index(a.field, a.type)
        return {"indexes": {k: str(v) for k, v in c.indexes.items()}}
    if a.command == "snapshot":
        return {"snapshot": c.create_snapshot(a.to)}
    return {"count": c.count(), "config": c.config.to_dict(), "indexes": {k: str(v) for k, v in c.indexes.items()}, "batches": len(c.manifest["batches"])}


if __name__ == "__main__":
    try:
        print(json.dumps(run(SparkSession.builder.appName("pointloom").getOrCreate(), sys.argv[1:]), sort_keys=True, separators=(",", ":")))
    except (PointloomError, ValueError) as e:
        sys.exit(f"{type(e).__name__}: {e}")
