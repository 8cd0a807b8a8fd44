"""Which way to search a segment, and which maintenance a collection needs most: two tables of rules over counts, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.config import OptimizerConfig


def search_strategy(threshold: int) -> Column:
    """Over total_points, filtered_maximum (null without a filter), has_hnsw, has_quantization, exact_requested."""
    filtered = F.col("filtered_maximum").isNotNull()
    return (
        F.when(F.col("exact_requested") | (F.col("total_points") <= threshold) | ~F.col("has_hnsw"), "exact_full_scan")
        .when(filtered & (F.col("filtered_maximum") <= threshold), "filter_then_exact")
        .when(F.col("has_quantization"), "quantized_hnsw_rescore")
        .when(filtered, "filtered_hnsw")
        .otherwise("hnsw")
    )


def maintenance(facts: DataFrame, config: OptimizerConfig) -> DataFrame:
    """One row (kind, segments) from segment facts (segment_id, live_points, deleted_points, indexed): vacuum the segment
    with the largest part of deleted rows, else merge the two smallest, else index the largest plain one, else none."""
    total = F.col("live_points") + F.col("deleted_points")
    ratio = F.when(total > 0, F.col("deleted_points") / total).otherwise(0.0)
    by = lambda key, where: F.min(F.when(where, F.struct(key.alias("key"), F.col("segment_id").alias("id"))))["id"]
    smallest = F.slice(F.sort_array(F.collect_list(F.struct(total.alias("total"), F.col("segment_id").alias("id")))), 1, 2)
    found = facts.agg(
        by(-ratio, (ratio >= config.deleted_ratio_threshold) & (F.col("deleted_points") > 0)).alias("vacuum"),
        F.count("*").alias("n"),
        smallest["id"].alias("smallest"),
        by(-F.col("live_points"), ~F.col("indexed") & (F.col("live_points") >= config.indexing_threshold_points)).alias("plain"),
    )  # one row; a collection's segments are few
    merge = F.col("n") > config.target_segment_count
    kind = F.when(F.col("vacuum").isNotNull(), "vacuum").when(merge, "merge").when(F.col("plain").isNotNull(), "index").otherwise("none")
    segments = F.when(F.col("vacuum").isNotNull(), F.array("vacuum")).when(merge, F.array_sort("smallest")).when(F.col("plain").isNotNull(), F.array("plain")).otherwise(F.array().cast("array<string>"))
    return found.select(kind.alias("kind"), F.array_join(segments, ",").alias("segments"))
