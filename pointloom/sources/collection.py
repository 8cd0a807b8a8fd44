"""A collection of versioned points, kept as Parquet tables.

Every batch is a table of its own below the collection's folder; a small JSON file, replaced by one rename, names the
batches that count. So a batch is there wholly or not at all, and a search keeps the batches that it began with. One
writer at a time. Paths may be on any file system that Spark writes to.

A batch has one row an id. Beside its payloads it has two columns for each payload index, and int8 codes of its vectors if
the collection is quantized, whose ranges are kept with the batch's name. The first batch is the base and the others are
changes to it: searches read of the base only the columns and, as Parquet can tell, the row groups that they need, and
shuffle none of it.
"""

from __future__ import annotations

import json
import math
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pointloom.config import CollectionConfig, Distance, PayloadSchema, ScalarQuantizationConfig
from pointloom.errors import ClosedResourceError, CollectionExistsError, CollectionNotFoundError, CorruptionError, InvalidPointError, InvalidVectorError, PayloadIndexError, SchemaMismatchError, SnapshotError, WriteConflictError
from pointloom.functions import quantize
from pointloom.functions.distance import normalized
from pointloom.operators import payload_index, search, versions
from pointloom.operators.filters import Condition, Match, compile_filter
from pointloom import ids

ROWS = "id {id}, vector array<double>, payload string, version long, ordinal int, deleted boolean"
_INDEX_TYPES = {PayloadSchema.KEYWORD: "string", PayloadSchema.INTEGER: "bigint", PayloadSchema.FLOAT: "double", PayloadSchema.BOOL: "boolean"}
_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """Where tables that a query makes go: spark.checkpoint.dir, or in tests a folder of our own."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="pointloom-"))
        path = _own_folder[0]
    return path.removeprefix("file://") if path.startswith("file:///") else path


def _one_of(wanted: list[int]) -> Column:
    """A test that Parquet can check by its bloom filters, id by id."""
    return reduce(lambda a, b: a | b, (F.col("id") == F.lit(i) for i in wanted), F.lit(False))


class _Files:
    """Small files, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def fs(self):
        return self.path().getFileSystem(self.conf)

    def exists(self, name: str = "") -> bool:
        return self.fs().exists(self.path(name))

    def read(self, name: str) -> dict:
        stream = self.fs().open(self.path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "ChecksumException":
                raise CorruptionError(f"{self.root}/{name}") from e
            raise
        finally:
            stream.close()

    def replace(self, name: str, value: dict) -> None:
        """Write beside, then rename over: readers see the old file or the new one."""
        beside = f".{name}-{uuid.uuid4().hex}"
        stream = self.fs().create(self.path(beside), True)
        stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path().toUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self.path(beside), self.path(name), options)


class Collection:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.files = spark, path, _Files(spark, path)
        if not self.files.exists("collection.json"):
            raise CollectionNotFoundError(path)
        self.closed = False
        try:
            described = self.files.read("collection.json")
            self.config = CollectionConfig.from_dict(described["config"])
        except (KeyError, TypeError, ValueError) as e:
            raise CorruptionError(f"{path}/collection.json") from e
        self._rows = ROWS.format(id="long" if self.config.ids == "integer" else "string")
        if described["fingerprint"] != self.config.fingerprint:
            raise SchemaMismatchError(path)
        self.indexes = {p: PayloadSchema(s) for p, s in described["indexes"].items()}

    @classmethod
    def create(cls, spark: SparkSession, path: str, *, dimension: int, distance: Distance, quantization: ScalarQuantizationConfig | None = None, **more) -> Collection:
        files = _Files(spark, path)
        if files.exists():
            raise CollectionExistsError(path)
        config = CollectionConfig(dimension, distance, quantization=quantization, **more)
        files.fs().mkdirs(files.path())
        files.replace("manifest.json", {"generation": 1, "batches": [], "facts": {}, "version": 0})
        files.replace("collection.json", {"config": config.to_dict(), "fingerprint": config.fingerprint, "indexes": {}})
        return cls(spark, path)

    open = classmethod(lambda cls, spark, path: cls(spark, path))

    def close(self) -> None:
        """Nothing is read or written through this object any more; searches that began stay as they are."""
        self.closed = True

    def drop(self) -> None:
        self.files.fs().delete(self.files.path(), True)

    # -- reading

    @property
    def manifest(self) -> dict:
        if self.closed:
            raise ClosedResourceError(self.path)
        try:
            state = self.files.read("manifest.json")
            state["batches"], state["facts"], state["version"]
        except (KeyError, TypeError, ValueError) as e:
            raise CorruptionError(f"{self.path}/manifest.json") from e
        return state

    # Inside, ids of any kind are keys (see pointloom.ids), in whose order and by which all is joined.

    def _keyed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("id", ids.key_of(F.col("id"))) if self.config.ids == "any" else df

    def _shown(self, df: DataFrame) -> DataFrame:
        return df.withColumn("id", ids.shown(F.col("id"))) if self.config.ids == "any" else df

    def rows(self, manifest: dict | None = None) -> DataFrame:
        """All rows of all batches, superseded ones included, with their segment_id; the batches of this moment, or of a manifest."""
        batches = (manifest or self.manifest)["batches"]
        if not batches:
            return self.spark.createDataFrame([], self._rows + ", segment_id string")
        tables = self.spark.read.schema(self._rows).parquet(*(f"{self.path}/{b}" for b in batches))
        return self._shown(tables).withColumn("segment_id", F.regexp_extract(F.input_file_name(), "/(batch-[^/]+)/", 1))

    def _batch(self, name: str, facts: dict) -> DataFrame:
        """A batch with all of its columns; index columns that it has not are null and tell nothing."""
        columns = "".join(f", {i.value} {_INDEX_TYPES[i.schema]}, {i.other} boolean" for p, i in self._indexed().items() if p in facts["indexes"])
        found = self.spark.read.schema(self._rows + columns + (", codes array<tinyint>" if "minima" in facts else "")).parquet(f"{self.path}/{name}")
        return found.withColumns({c: F.lit(v).cast(t) for p, i in self._indexed().items() if p not in facts["indexes"] for c, v, t in ((i.value, None, _INDEX_TYPES[i.schema]), (i.other, True, "boolean"))})

    def _indexed(self) -> dict[str, payload_index.Indexed]:
        return {p: payload_index.Indexed(f"__pidx_{n}", f"__pother_{n}", s) for n, (p, s) in enumerate(self.indexes.items())}

    def _live(self, *columns: str, where: Column | None = None, coded: bool = False, state: dict | None = None) -> DataFrame:
        """id, columns and version of the live points that pass `where`, a test of stored columns. With `coded`, `about`
        columns say how a batch's codes are read: minima, scales."""
        state = state or self.manifest
        if not state["batches"]:
            return self.spark.createDataFrame([], self._rows).select("id", "version", *columns) if not coded else None
        parts, extra = [], ("minima", "scales") if coded else ()
        for name in state["batches"]:
            facts = state["facts"][name]
            found = self._batch(name, facts)
            if coded:
                ranges = self.spark.createDataFrame([(facts["minima"], facts["scales"])], "minima array<double>, scales array<double>")
                found = found.crossJoin(F.broadcast(ranges))  # one row
            keep = [c for i in self._indexed().values() for c in (i.value, i.other)] if where is not None else []
            parts.append(found.select(*dict.fromkeys(["id", "version", "ordinal", "deleted", *columns, *keep, *extra])))
        pass_ = lambda found: found if where is None else found.where(where)
        base, rest = pass_(parts[0].where(~F.col("deleted"))), parts[1:]
        if rest:
            delta = reduce(DataFrame.unionByName, rest)
            base = versions.latest_by_delta(base, delta, sum(state["facts"][b]["rows"] for b in state["batches"][1:]))
            base = pass_(base.where(~F.col("deleted")))
        return base.select("id", "version", *columns, *extra)

    def points(self) -> DataFrame:
        """id, vector, payload (VARIANT) and version of live points. Only changes to the first batch are shuffled."""
        return self._shown(self._points())

    def _points(self) -> DataFrame:
        return self._live("vector", "payload").select("id", "vector", F.parse_json("payload").alias("payload"), "version")

    def count(self) -> int:
        return self._live().count()

    def segment_statistics(self) -> DataFrame:
        return versions.segment_statistics(self.rows())

    def retrieve(self, wanted: DataFrame) -> DataFrame:
        return self._shown(search.retrieve(self._points(), self._keyed(wanted)))

    def _holds(self, condition: Condition) -> Column:
        return compile_filter(condition, F.col("payload"), ids.key_of_integers(F.col("id")) if self.config.ids == "integer" else F.col("id"))

    def search(self, query: DataFrame, k: int, condition: Condition | None = None, threshold: float | None = None, exact: bool = False, facts: Observation | None = None, with_payload: bool = True, with_vector: bool = False) -> DataFrame:
        """id, version and score of the k nearest live points to the one row q of query, with their payloads (VARIANT) and
        vectors if asked for; through int8 codes if the collection is quantized and neither exact nor a threshold is asked for.

        Payload indexes choose what is read; the condition is evaluated on that. facts, if given, counts `let_through` (live
        points that the indexes did not rule out) and `scored` (those that satisfy the condition) once the search has run.
        """
        asked = query.first()["q"]  # one row
        if asked is None or len(asked) != self.config.dimension or not all(x is not None and math.isfinite(x) for x in asked) or (self.config.distance == Distance.COSINE and not any(asked)):
            raise InvalidVectorError(f"a query needs {self.config.dimension} finite numbers, not all 0 for cosine")
        shown = [*(["payload"] if with_payload else []), *(["vector"] if with_vector else [])]
        if self.config.quantization and not exact and threshold is None and self.manifest["batches"]:
            near = self._nearest_codes(query, k * self.config.quantization.oversampling, condition, facts)
            ids_of = [r["id"] for r in near.select("id").collect()]  # k times oversampling at most
            chosen = self._live("vector", "payload", where=_one_of(ids_of)).select("id", "vector", F.parse_json("payload").alias("payload"), "version")
            return self._shown(search.top_k(chosen, query, k, self.config.distance)).select("id", "version", "score", *shown)
        found = self._matching("vector", condition=condition, facts=facts)
        return self._shown(search.top_k(found, query, k, self.config.distance, threshold=threshold)).select("id", "version", "score", *shown)

    def _matching(self, *columns: str, condition: Condition | None, facts: Observation | None, coded: bool = False) -> DataFrame:
        """id, columns, payload (VARIANT) and version of the live points that satisfy the condition."""
        told = None if condition is None else payload_index.candidates(condition, self._indexed())
        if condition is not None or not coded:
            columns = (*columns, "payload")
        found = self._live(*columns, where=told, coded=coded)
        if "payload" in columns:
            found = found.withColumn("payload", F.parse_json("payload"))
        holds = F.lit(True) if condition is None else self._holds(condition)
        if facts is not None:
            found = found.withColumn("_holds", holds).observe(facts, F.count(F.lit(1)).alias("let_through"), F.count_if("_holds").alias("scored"))
            holds = F.col("_holds")
        return found.where(holds).drop("_holds")

    def nearest_codes(self, query: DataFrame, k: int, condition: Condition | None = None, facts: Observation | None = None) -> DataFrame:
        """id and score (`about`) of the k nearest live points by their stored codes: vectors are not read, and, without a
        condition, payloads neither. The query is coded and decoded with each batch's ranges."""
        return self._shown(self._nearest_codes(query, k, condition, facts))

    def _nearest_codes(self, query: DataFrame, k: int, condition: Condition | None, facts: Observation | None) -> DataFrame:
        found = self._matching("codes", condition=condition, facts=facts, coded=True)
        return search.top_k_by_codes(found, query, k, self.config.distance)

    # -- writing

    def _append(self, make: Callable[[int], DataFrame], upto: dict | None = None, epochs: dict[str, int] | None = None) -> int:
        """Write make(version) as a batch and publish it; with upto, in place of the batches of that manifest."""
        state = upto or self.manifest
        version = state["version"] + (upto is None)
        name = f"batch-{version:012d}-{uuid.uuid4().hex[:8]}"
        facts = self._write(make(version), f"{self.path}/{name}")
        now = self.manifest  # others may have published meanwhile
        if upto is None and now["version"] != state["version"]:
            raise WriteConflictError(f"version {version} was taken while it was written; write again")
        late = [b for b in now["batches"] if b not in state["batches"]] if upto else []
        if upto and len(late) != len(now["batches"]) - len(state["batches"]):
            raise WriteConflictError("the batches were replaced meanwhile")
        batches = [name, *late] if upto else [*now["batches"], name]
        all_facts = {b: facts if b == name else now["facts"][b] for b in batches}
        self.files.replace("manifest.json", {"generation": now["generation"] + 1, "batches": batches, "facts": all_facts, "version": max(version, now["version"]), "epochs": now.get("epochs", {}) | (epochs or {})})
        return version

    def _write(self, rows: DataFrame, path: str) -> dict:
        """Writes rows with their index columns and codes; returns what the manifest keeps of the batch. Rows are in the
        order of the first index's column, whose row groups so hold narrow ranges; others have bloom filters."""
        facts: dict = {"indexes": list(self.indexes)}
        for path_, i in self._indexed().items():
            value, other = payload_index.stored(F.parse_json("payload"), path_, i.schema)
            rows = rows.withColumns({i.value: value, i.other: other})
        if self.config.quantization:
            if fitted := quantize.fit(rows.where(~F.col("deleted"))).first():  # one row
                facts |= {"minima": fitted["minima"], "scales": fitted["scales"]}
            else:  # deletions only
                facts |= {"minima": [0.0] * self.config.dimension, "scales": [0.0] * self.config.dimension}
            ranges = self.spark.createDataFrame([(facts["minima"], facts["scales"])], "minima array<double>, scales array<double>")
            coded = quantize.encode(F.col("vector"), F.col("minima"), F.col("scales"))
            rows = rows.crossJoin(F.broadcast(ranges)).withColumn("codes", F.when(F.col("deleted"), F.array().cast("array<tinyint>")).otherwise(coded)).drop("minima", "scales")
        indexed = list(self._indexed().values())
        writer = (rows.repartitionByRange(indexed[0].value).sortWithinPartitions(indexed[0].value, "id") if indexed else rows).write
        for name in ["id", *(i.value for i in indexed)]:
            writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
        writer.parquet(path)
        return facts | {"rows": self.spark.read.parquet(path).count()}

    def _checked(self, points: DataFrame) -> DataFrame:
        """Raises unless every id is a whole number of 0 or more, and every vector is finite and of the dimension (and not zero, for cosine). One job."""
        v = F.col("vector")
        finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        good = v.isNotNull() & (F.size(v) == self.config.dimension) & F.coalesce(finite, F.lit(False))
        if self.config.distance == Distance.COSINE:
            good &= F.exists(v, lambda x: x != 0)
        payload = F.try_parse_json(F.coalesce("payload", F.lit("{}")))
        shaped = F.coalesce(F.schema_of_variant(payload).startswith("OBJECT"), F.lit(False))
        bad = points.agg(F.count_if(F.col("id").isNull() if self.config.ids == "any" else F.coalesce(F.col("id") < 0, F.lit(True))), F.count_if(~good), F.count_if(~shaped), F.count("*")).first()
        if bad[0] or bad[2]:
            raise InvalidPointError(f"{bad[0]} ids are null, negative or none at all, {bad[2]} payloads are not JSON objects")
        if bad[1]:
            raise InvalidVectorError(f"{bad[1]} vectors do not fit")
        if not bad[3]:
            raise ValueError("no points")
        return points.withColumn("vector", normalized("vector")) if self.config.distance == Distance.COSINE else points

    def upsert(self, points: DataFrame) -> int:
        """points: id, vector, payload (JSON text, null for {}); returns the version. The whole batch is checked first.

        Of rows with one id the first counts, by `ordinal` if there is such a column, else by the smallest payload and vector.
        """
        cast = self._keyed(points).select("id", F.col("vector").cast("array<double>").alias("vector"), "payload", *(["ordinal"] if "ordinal" in points.columns else []))
        good = self._checked(cast).withColumn("payload", F.coalesce("payload", F.lit("{}")))
        order = ["ordinal"] if "ordinal" in points.columns else []
        first = good.groupBy("id").agg(F.min(F.struct(*order, "payload", "vector")).alias("s")).select("id", "s.vector", "s.payload")
        return self._append(lambda v: first.select("*", F.lit(v).cast("long").alias("version"), F.lit(0).alias("ordinal"), F.lit(False).alias("deleted")))

    def delete(self, wanted: DataFrame) -> int:
        """Hides the ids of wanted (id), whether they are there or not."""
        empty = F.array().cast("array<double>").alias("vector")
        rows = self._keyed(wanted.select("id")).distinct()
        if not rows.where("id IS NULL").isEmpty():
            raise InvalidPointError("an id is null or none at all")
        return self._append(lambda v: rows.select("id", empty, F.lit("{}").alias("payload"), F.lit(v).cast("long").alias("version"), F.lit(0).alias("ordinal"), F.lit(True).alias("deleted")))

    def apply(self, operations: DataFrame, source: str | None = None, epoch: int | None = None) -> int | None:
        """One version of operations (seq, kind `upsert` or `delete`, id, vector, payload): of each id the one of the
        greatest seq counts (of several, a deletion). With source and epoch, a number that grows by source, an epoch that the
        collection has seen does nothing; both are kept in the same file as the version. Returns the version, or None."""
        if source is not None and epoch <= self.manifest.get("epochs", {}).get(source, -1):
            return None
        columns = ["vector", "payload"]
        last = self._keyed(operations).groupBy("id").agg(F.max_by(F.struct(*(F.col(c) for c in ("kind", *columns))), F.struct("seq", F.col("kind") == "delete")).alias("o")).select("id", "o.*")
        if not last.where(~F.coalesce(F.col("kind").isin("upsert", "delete"), F.lit(False)) | F.col("id").isNull() | (F.lit(self.config.ids == "integer") & (F.col("id") < ("0" if self.config.ids == "any" else 0)))).isEmpty():
            raise InvalidPointError("operations need an id of 0 or more, and are of kind upsert or delete")
        if last.isEmpty():
            return None
        upserts, gone = last.where("kind = 'upsert'"), last.where("kind = 'delete'").select("id")
        if not upserts.isEmpty():
            upserts = self._checked(upserts.select("id", F.col("vector").cast("array<double>").alias("vector"), "payload"))
        upserts = upserts.select("id", "vector", F.coalesce("payload", F.lit("{}")).alias("payload"), F.lit(False).alias("deleted"))
        both = upserts.unionByName(gone.select("id", F.array().cast("array<double>").alias("vector"), F.lit("{}").alias("payload"), F.lit(True).alias("deleted")))
        return self._append(lambda v: both.select("id", "vector", "payload", F.lit(v).cast("long").alias("version"), F.lit(0).alias("ordinal"), "deleted"), epochs={} if source is None else {source: epoch})

    def _patch(self, wanted: DataFrame, change: Callable[[Column], Column]) -> int | None:
        """New versions of wanted's live points with changed payloads; None, and no version, if there are none."""
        hit = self._points().join(self._keyed(wanted.select("id")), "id", "left_semi")
        if hit.isEmpty():
            return None
        new = hit.select("id", "vector", F.to_json(change(F.col("payload"))).alias("payload"))
        return self._append(lambda v: new.select("*", F.lit(v).cast("long").alias("version"), F.lit(0).alias("ordinal"), F.lit(False).alias("deleted")))

    def replace_payload(self, wanted: DataFrame, payload: str) -> int | None:
        return self._patch(wanted, lambda _: F.parse_json(F.lit(payload)))

    def merge_payload(self, wanted: DataFrame, fields: str) -> int | None:
        return self._patch(wanted, lambda p: versions.merged(p, F.parse_json(F.lit(fields))))

    def delete_payload_keys(self, wanted: DataFrame, keys: list[str]) -> int | None:
        return self._patch(wanted, lambda p: versions.without_keys(p, keys))

    def create_payload_index(self, path: str, schema: PayloadSchema) -> None:
        """From now on every batch is written with the index's columns; what is there is rewritten once, so that it has them."""
        try:
            Match(path, None)
            schema = PayloadSchema(schema)
        except ValueError as e:
            raise PayloadIndexError(str(e)) from e
        if self.indexes.get(path, schema) != schema:
            raise PayloadIndexError(f"{path} has an index of type {self.indexes[path]}")
        if path in self.indexes:
            return
        self.indexes[path] = schema
        described = self.files.read("collection.json")
        self.files.replace("collection.json", described | {"indexes": {p: str(s) for p, s in self.indexes.items()}})
        if self.manifest["batches"]:
            self.optimize()

    def indexed_points(self) -> DataFrame:
        """points() and the columns of each payload index, __pidx_<n> and __pother_<n> in the order of their making."""
        columns = [c for i in self._indexed().values() for c in (i.value, i.other)]
        return self._shown(self._live("vector", "payload", *columns).withColumn("payload", F.parse_json("payload")))

    def optimize(self) -> None:
        """One batch of live points in place of all that are there now; batches published meanwhile stay beside it.
        Earlier files stay for readers that hold them, until vacuum()."""
        state = self.manifest
        self._append(lambda _: self._live("vector", "payload", state=state).select("id", "vector", "payload", "version", F.lit(0).alias("ordinal"), F.lit(False).alias("deleted")), upto=state)

    def vacuum(self) -> int:
        """Deletes batches that do not count any more; only when no search of theirs is at work."""
        fs, keep, gone = self.files.fs(), set(self.manifest["batches"]), 0
        for status in fs.listStatus(self.files.path()):
            if (name := status.getPath().getName()).startswith("batch-") and name not in keep:
                gone += fs.delete(status.getPath(), True)
        return gone

    # -- snapshots

    def create_snapshot(self, destination: str) -> str:
        """Copies what counts now; the manifest last, so that a snapshot with a manifest is whole."""
        to = _Files(self.spark, destination)
        if to.exists():
            raise SnapshotError(f"{destination} is there already")
        state = self.manifest
        for batch in state["batches"]:
            self.spark.read.parquet(f"{self.path}/{batch}").write.parquet(f"{destination}/{batch}")
        to.fs().mkdirs(to.path())
        to.replace("collection.json", self.files.read("collection.json"))
        counts = {b: self.spark.read.parquet(f"{destination}/{b}").count() for b in state["batches"]}
        to.replace("manifest.json", state | {"rows": counts})
        return destination

    @classmethod
    def restore(cls, spark: SparkSession, snapshot: str, path: str) -> Collection:
        """Checks the snapshot's settings and row counts before anything is written."""
        if _Files(spark, path).exists():
            raise CollectionExistsError(path)
        if not _Files(spark, snapshot).exists("manifest.json"):
            raise SnapshotError(f"{snapshot} has no manifest")
        source = cls(spark, snapshot)
        for batch, n in source.manifest.get("rows", {}).items():
            if spark.read.parquet(f"{snapshot}/{batch}").count() != n:
                raise SnapshotError(f"{batch} is not whole")
        source.create_snapshot(path)
        return cls(spark, path)
