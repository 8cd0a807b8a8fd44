"""Long sequences of rows, such as the turns of conversations, dealt over tasks by their order.

A sequence may hold any part of all rows. So rows are dealt by range over (sequence, order), into parts; what a part has
of one sequence is a segment. Facts of a sequence come from facts of its segments: a sequence has one segment a part at
most, and a part has two segments at most that do not hold their whole sequence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import cut, in_small_batches, partitions


def dealt_in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows at rest, with the number `part` of their range over `order`, nulls first, and their place `pos`: a number that
    grows in that order, by one from row to row of a part."""
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    return cut(dealt.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()))


def segments(dealt: DataFrame, *sequence: str) -> DataFrame:
    """One row for each (part, sequence) of dealt rows: n rows, `before` rows of the sequence in earlier parts, `total` in all."""
    found = dealt.groupBy("part", *sequence).agg(F.count("*").alias("n"))
    of = Window.partitionBy(*sequence)
    earlier = of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("total", F.sum("n").over(of))


def _runs(columns: list[np.ndarray]) -> list[tuple[int, int]]:
    """Where runs of equal rows begin and end."""
    n = len(columns[0])
    changes = np.zeros(n, bool)
    for c in columns:
        changes[1:] |= c[1:] != c[:-1]
    starts = [0, *np.flatnonzero(changes).tolist()]
    return list(zip(starts, [*starts[1:], n], strict=True)) if n else []


def sha256_of_chunks(chunks: DataFrame, keys: list[str], order: list[str], between: str) -> DataFrame:
    """keys (longs, not null) and the lowercase hex `sha256` of each key's texts `chunk`, joined by `between` in the order
    of `order`. A key's chunks pass one task, as the hash is of one sequence of bytes, but the task holds one batch only."""
    names = ", ".join(f"{k} long" for k in keys)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            found = []
            for *key, text in zip(*(batch.column(k).to_pylist() for k in keys), batch.column("chunk").to_pylist(), strict=True):
                if key == now:
                    state.update(between.encode())
                else:
                    if now is not None:
                        found.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                state.update(text.encode("utf-8", "surrogatepass"))
            yield _batch(found)
        if now is not None:
            yield _batch([(*now, state.hexdigest())])

    def _batch(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [()] * (len(keys) + 1)
        return pa.record_batch([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.string())], [*keys, "sha256"])

    dealt = in_small_batches(chunks).repartition(partitions(chunks.sparkSession), *keys).sortWithinPartitions(*keys, *order)
    return dealt.select(*keys, "chunk").mapInArrow(hashed, f"{names}, sha256 string")


def sha256_of_ids(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys (longs, not null) and the `sha256` of each key's decimal values, ascending and joined by commas.

    Range by range, runs of values become texts of a batch's length at most; only these are brought together by key.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            values = batch.column(value).to_pylist()
            runs = _runs(columns)
            at = [a for a, _ in runs]
            texts = [",".join(map(str, values[a:b])) for a, b in runs]
            yield pa.record_batch([*(pa.array(c[at]) for c in columns), pa.array([values[a] for a in at], pa.int64()), pa.array(texts, pa.string())], [*keys, "first", "chunk"])

    dealt = in_small_batches(rows).select(*keys, value).repartitionByRange(partitions(rows.sparkSession), *keys, value).sortWithinPartitions(*keys, value)
    chunks = dealt.mapInArrow(joined, ", ".join(f"{k} long" for k in keys) + ", first long, chunk string")
    return sha256_of_chunks(chunks, keys, ["first"], ",")
