"""Scalar quantization: each dimension's range in 255 steps, as codes from -128 to 127."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ranges(vector: str):
    """Least and greatest component of each dimension, one row a batch: what is shuffled does not grow with the points."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(vector).drop_null()
            flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
            for d in np.unique(sizes[sizes > 0]).tolist():  # one size, unless the points are ragged
                rows = flat[np.repeat(sizes == d, sizes)].reshape(-1, d)
                yield pa.record_batch([pa.array([x.tolist()], pa.list_(pa.float64())) for x in (np.fmin.reduce(rows), np.fmax.reduce(rows))], ["low", "high"])

    return of


def fit(points: DataFrame, vector: str = "vector") -> DataFrame:
    """One row: minima and scales, arrays over the dimensions; a constant dimension has scale 0. No row without points."""
    ranges = points.select(vector).mapInArrow(_ranges(vector), "low array<double>, high array<double>")
    by = ranges.select(F.posexplode(F.arrays_zip("low", "high")).alias("dim", "x")).groupBy("dim").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    rows = by.select("dim", F.struct("dim", "low", ((F.col("high") - F.col("low")) / 255).alias("scale")).alias("s"))
    return rows.agg(F.sort_array(F.collect_list("s")).alias("s")).where(F.size("s") > 0).select(F.col("s.low").alias("minima"), F.col("s.scale").alias("scales"))


def _three(a: Column, b: Column, c: Column, f) -> Column:
    return F.zip_with(a, F.arrays_zip(b.alias("p"), c.alias("q")), lambda x, y: f(x, y["p"], y["q"]))


def encode(v: Column, minima: Column, scales: Column) -> Column:
    """Rounds half to even; values outside the fitted range are clamped."""
    code = lambda x, low, scale: F.when(scale == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.rint((x - low) / scale) - 128)))
    return F.transform(_three(v, minima, scales, code), lambda c: c.cast("tinyint"))


def decode(codes: Column, minima: Column, scales: Column) -> Column:
    return _three(codes, minima, scales, lambda c, low, scale: F.when(scale == 0, low).otherwise(low + (c + 128) * scale))


def error_bound(scales: Column) -> Column:
    return F.array_max(scales) / 2
