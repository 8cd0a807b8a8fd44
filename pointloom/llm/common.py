"""What the operators of this subpackage share: reading a table, cutting lineage, and counts of partitions."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where it is unset (tests), one of our own."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="pointloom-"))
    return _own_folder[0]


def cut(df: DataFrame) -> DataFrame:
    """Write df to a table in the shared folder, and read it from there from now on.

    Lost executors then cost no more than the step at hand. What was shuffled to make df is of no use any more: the
    collection of garbage lets Spark's cleaner drop those files, once nobody holds the tables they belong to.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pointloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Whole texts go to Python at most so many rows, and about so many bytes, at a time: Spark's own 10,000 rows would take a
#: task's memory by the texts' length. (A single text beyond that is a batch of its own.)
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def in_small_batches(docs: DataFrame) -> DataFrame:
    """docs, of whose session Arrow batches from now on hold BATCH_ROWS rows and about BATCH_BYTES bytes at most, or fewer
    if it says so. No result depends on the batches."""
    conf = docs.sparkSession.conf
    for key, most in _BATCH.items():
        said = conf.get(key).removesuffix("b")  # what has another unit was set by somebody, and holds
        if said.lstrip("-").isdigit() and not 0 < int(said) <= most:
            conf.set(key, str(most))
    return docs


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus: which rows a model may learn from. A null id counts as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")), F.lit(0)) % modulus


#: Bits of the bitmap of `maybe_in`: 2 MB, whatever the tables' sizes.
FILTER_BITS = 24


def maybe_in(rows: DataFrame, column: str, wanted: DataFrame, maybe: bool = True) -> DataFrame:
    """rows whose `column` may be among the values of wanted's only column, which is to be a table at rest; or, with
    maybe=False, the other rows, which surely are not. Hashes in a bitmap of fixed size tell. Before a join, this spares
    the shuffle most rows. Nulls are values."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))
    at = wanted.select(place(wanted.columns[0]).alias("at"))
    found = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("mask"))
    words = rows.sparkSession.range(1 << (FILTER_BITS - 6)).withColumnRenamed("id", "word").join(found, "word", "left")
    masks = words.agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("mask", F.lit(0)).alias("mask")))).alias("m")).select("m.mask")
    here = place(column)
    bit = F.call_function("shiftright", masks.scalar()[F.shiftright(here, 6)], (here % 64).cast("int"))
    return rows.where(bit.bitwiseAND(F.lit(1)) == int(maybe))
