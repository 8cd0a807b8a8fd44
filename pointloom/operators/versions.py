"""Versioned rows: id, version, ordinal (place within its batch), deleted, and what the point holds.

The greatest version of an id is its state; of one batch's rows for an id, the first counts. A deleted row hides all
earlier ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, id_column: str = "id") -> DataFrame:
    """Each id's last state, deletions included. Tasks reduce their own rows before the shuffle, so no id is too hot."""
    rest = [c for c in rows.columns if c != id_column]
    state = F.max_by(F.struct(*rest), F.struct("version", -F.col("ordinal")))
    return rows.groupBy(id_column).agg(state.alias("s")).select(id_column, *(F.col("s")[c].alias(c) for c in rest)).select(*rows.columns)


def live(rows: DataFrame, id_column: str = "id") -> DataFrame:
    return latest(rows, id_column).where(~F.col("deleted"))


#: Changed ids that all tasks may hold at once: some tens of MB.
BROADCAST_IDS = 1_000_000


def latest_by_delta(base: DataFrame, delta: DataFrame, delta_rows: int | None = None, id_column: str = "id") -> DataFrame:
    """Each id's last state of base and delta together, deletions included, where base has one row an id, older than all
    of delta: the base rows that delta does not change, and delta's own last states.

    Only delta is shuffled. Its ids go to all tasks if they are few (delta_rows, counted if not given); otherwise they
    are joined as Spark sees fit.
    """
    few = (delta.count() if delta_rows is None else delta_rows) <= BROADCAST_IDS
    changed = delta.select(id_column)  # an id that repeats changes nothing in an anti-join
    unchanged = base.join(F.broadcast(changed) if few else changed.distinct(), id_column, "left_anti")
    return unchanged.select(*base.columns).unionByName(latest(delta, id_column))


def newer_than(rows: DataFrame, boundary: int) -> DataFrame:
    """What a compaction that captured versions up to boundary must keep."""
    return rows.where(F.col("version") > boundary)


def compacted(rows: DataFrame, boundary: int, id_column: str = "id") -> DataFrame:
    """One live row an id for versions up to boundary, and all later rows as they are."""
    return live(rows.where(F.col("version") <= boundary), id_column).unionByName(newer_than(rows, boundary))


def segment_statistics(rows: DataFrame, segment: str = "segment_id") -> DataFrame:
    """Physical counts: superseded rows count."""
    return rows.groupBy(segment).agg(F.count_if(~F.col("deleted")).alias("live_points"), F.count_if("deleted").alias("deleted_points"))


def merged(payload: Column, fields: Column) -> Column:
    """Top-level keys of fields over those of payload, both VARIANT objects; a nested value is replaced whole."""
    of = lambda v: F.coalesce(v.cast("map<string,variant>"), F.create_map().cast("map<string,variant>"))
    kept = F.map_filter(of(payload), lambda k, _: ~F.map_contains_key(of(fields), k))
    return F.to_variant_object(F.map_concat(kept, of(fields)))


def without_keys(payload: Column, keys: list[str]) -> Column:
    return F.to_variant_object(F.map_filter(payload.cast("map<string,variant>"), lambda k, _: ~k.isin(keys)))
