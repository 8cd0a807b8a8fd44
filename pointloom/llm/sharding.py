"""Operator 8: contiguous shards of nearly equal bytes, cut from global prefix sums.

The rows are dealt by range over their order columns; the bytes and rows of each range are summed, a running sum over
these few totals gives where each range starts, and a running sum inside each range does the rest. No task sees more
than one range, and only one row a partition is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm.common import cut, partitions, table

SHARDS = 24
ROW_OVERHEAD = 8


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 8; a null text has none) and the text's CRC-32 (0 for null or empty)."""
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )


def prefix_sum_shards(rows: DataFrame, order: list[str], size: str = "size", shards: int = SHARDS) -> DataFrame:
    """rows with shard, slot and start (the bytes before the row, in the order of `order`, nulls first).

    A row goes to the shard into whose equal share of all bytes its middle byte falls. So shards are contiguous in
    the order, and their sizes differ from the target by less than the largest row. Rows equal in every column of
    `order` and in size may stand in for one another. An empty table gives an empty result. `rows` must not have
    columns that start with `_ps_`; other columns are carried along, but for those named shard, slot or start.
    """
    spark = rows.sparkSession
    order = [*order, size]
    dealt = cut(rows.repartitionByRange(partitions(spark), *order).withColumn("_ps_part", F.spark_partition_id()))
    before = Window.orderBy("_ps_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_ps_part").agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"))
    starts = totals.select(
        "_ps_part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("_ps_bytes"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_ps_rows"),
        F.sum("bytes").over(Window.partitionBy()).alias("_ps_all"),
    )  # one row a partition
    inside = Window.partitionBy("_ps_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        dealt.join(F.broadcast(starts), "_ps_part")
        .withColumn("start", F.col("_ps_bytes") + F.sum(size).over(inside) - F.col(size))
        .withColumn("_ps_row", F.col("_ps_rows") + F.count("*").over(inside) - 1)
        .withColumn("shard", F.expr(f"cast(least({shards - 1}, (2 * start + {size}) * {shards} div greatest(2 * _ps_all, 1)) as int)"))
    )
    first = placed.groupBy("shard").agg(F.min("_ps_row").alias("_ps_first"))  # one row a shard
    placed = placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("_ps_row") - F.col("_ps_first"))
    return placed.select(*(c for c in rows.columns if c not in ("shard", "slot", "start")), "shard", "slot", "start")


def op8_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = prefix_sum_shards(document_sizes(table(spark, sf_dir, "documents")), ["doc_id", "text_crc32"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: The same with CRC-32 worked out byte by byte, by the table of its polynomial.
OP8_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))) AS t
), coded AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents
), bytes AS (
  SELECT doc_id, n, list_transform(range(n), lambda i: CAST('0x' || substring(h, 2 * i + 1, 2) AS BIGINT)) AS b FROM coded
), sized AS (
  SELECT doc_id, n + 8 AS size, xor(list_reduce([4294967295] || b, lambda c, x: xor(c >> 8, t[1 + xor(c, x) % 256])), 4294967295) AS text_crc32 FROM bytes, crc
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total FROM sized
), sharded AS (
  SELECT doc_id, size, text_crc32, start, CAST(least(23, (2 * start + size) * 24 // greatest(2 * total, 1)) AS INTEGER) AS shard FROM placed
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
 row_number() OVER (PARTITION BY shard ORDER BY start, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM sharded
"""
