"""Payload indexes: typed columns kept beside a nested payload, and what they tell of a filter's cardinality.

An index of a path has two columns, which are written with every batch: the row's only leaf there, if it is of the index's
type, and whether there are leaves besides. An indexed condition is a test of these that every matching row passes and that
Parquet can check for whole row groups; the filter itself always decides, so an index never changes a result.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.config import PayloadSchema
from pointloom.operators.filters import Condition, Filter, Match, Range, compiled_leaves

KINDS = {
    PayloadSchema.KEYWORD: ("^STRING$", "string"),
    PayloadSchema.INTEGER: (r"^(BIGINT|DECIMAL\(\d+,0\))$", "decimal(38,0)"),
    PayloadSchema.FLOAT: ("^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "double"),
    PayloadSchema.BOOL: ("^BOOLEAN$", "boolean"),
}


def extract(payload: Column, path: str, schema: PayloadSchema) -> Column:
    """The leaves at path that the schema accepts, as an array of its type."""
    pattern, kind = KINDS[PayloadSchema(schema)]
    typed = F.transform(compiled_leaves(payload, path), lambda x: F.when(F.schema_of_variant(x).rlike(pattern), F.try_variant_get(x, "$", kind)))
    return F.array_compact(typed)


def postings(points: DataFrame, index: str) -> DataFrame:
    """value, points, low_id, high_id: the inverted index of an extracted column, summarised."""
    values = points.select("id", F.explode(F.array_distinct(index)).alias("value"))
    return values.groupBy("value").agg(F.count("*").alias("points"), F.min("id").alias("low_id"), F.max("id").alias("high_id"))


LONGS = range(-(1 << 63), 1 << 63)
EXACT = 1 << 53  # whole numbers up to here are doubles

_WHOLE = r"^(BIGINT|DECIMAL\(\d+,0\))$"


def stored(payload: Column, path: str, schema: PayloadSchema) -> tuple[Column, Column]:
    """Two columns to be kept beside a payload: the only leaf at path, if the schema's type holds it exactly, else null;
    and whether there are leaves that the first column does not tell. So nothing needs to be believed of other rows."""
    schema = PayloadSchema(schema)
    leaves = compiled_leaves(payload, path)
    x = F.when(F.size(leaves) == 1, F.get(leaves, F.lit(0)))
    kind = F.schema_of_variant(x)
    as_type = lambda pattern, t: F.when(kind.rlike(pattern), F.try_variant_get(x, "$", t))
    if schema == PayloadSchema.KEYWORD:
        value = as_type("^STRING$", "string")
    elif schema == PayloadSchema.BOOL:
        value = as_type("^BOOLEAN$", "boolean")
    elif schema == PayloadSchema.INTEGER:
        value = as_type(_WHOLE, "bigint")
    else:
        number = as_type("^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "double")
        value = F.when(~kind.rlike(_WHOLE) | (F.abs(number) <= EXACT), number)
    return value, (F.size(leaves) > 0) & value.isNull()


@dataclass(frozen=True)
class Indexed:
    """The names of an index's two columns (see `stored`) and its type."""

    value: str
    other: str
    schema: PayloadSchema


def _match(index: Indexed, value: object) -> Column | None:
    """Which rows' only leaf may equal the value; None: none may."""
    column, number = F.col(index.value), isinstance(value, (bool, int, float))
    if index.schema == PayloadSchema.KEYWORD:
        return column == F.lit(value) if isinstance(value, str) else None
    if not number:
        return None
    if index.schema == PayloadSchema.BOOL:
        return column == F.lit(bool(value)) if value in (0, 1) else None
    if index.schema == PayloadSchema.FLOAT:
        return column == F.lit(float(value)) if abs(value) <= sys.float_info.max and float(value) == value else None
    return column == F.lit(int(value)) if value == int(value) and int(value) in LONGS else None


def _range(index: Indexed, r: Range) -> Column | None:
    """Which rows' only leaf may be within the bounds; None: none may."""
    if index.schema not in (PayloadSchema.INTEGER, PayloadSchema.FLOAT):
        return None
    column, parts = F.col(index.value), []
    lows, highs = [b for b in (r.gt, r.gte) if b is not None], [b for b in (r.lt, r.lte) if b is not None]
    if index.schema == PayloadSchema.FLOAT:  # the bound itself stays within: the filter decides
        parts = [column >= F.lit(float(b)) for b in lows if abs(b) < 1e300] + [column <= F.lit(float(b)) for b in highs if abs(b) < 1e300]
    else:
        for low in (math.floor(b) + 1 if b is r.gt else math.ceil(b) for b in lows):
            if low > LONGS[-1]:
                return None
            parts += [column >= F.lit(low)] if low in LONGS else []
        for high in (math.ceil(b) - 1 if b is r.lt else math.floor(b) for b in highs):
            if high < LONGS[0]:
                return None
            parts += [column <= F.lit(high)] if high in LONGS else []
    return reduce(lambda a, b: a & b, parts, column.isNotNull())


def candidates(condition: Condition, indexes: dict[str, Indexed]) -> Column | None:
    """A test of stored columns that every row passes which satisfies the condition, of a form that Parquet can check for
    whole row groups; None where the indexes tell nothing. The condition itself always decides."""
    if isinstance(condition, Filter):
        must = [candidates(c, indexes) for c in condition.must]
        should = [candidates(c, indexes) for c in condition.should]
        known = [c for c in must if c is not None]
        if should and all(c is not None for c in should):
            known.append(reduce(lambda a, b: a | b, should))
        return reduce(lambda a, b: a & b, known) if known else None
    index = indexes.get(getattr(condition, "path", ""))
    if index is None:
        return None
    told = _match(index, condition.value) if isinstance(condition, Match) else _range(index, condition)
    other = F.col(index.other)
    return other if told is None else told | other


def type_profile(points: DataFrame, payload: str, paths: list[str]) -> DataFrame:
    """path, leaves, strings, integers, numbers (other than integers), booleans, nulls, objects, and
    homogeneous (whether all leaves are of one of these) for each path: what an index of a type would hold.

    One pass of sums, combined in the tasks before they are shuffled; profiles of batches can be added up.
    """
    kinds = {"strings": "^STRING$", "integers": _WHOLE, "numbers": "^(DECIMAL|DOUBLE|FLOAT)", "booleans": "^BOOLEAN$", "nulls": "^VOID$", "objects": "^OBJECT"}
    read = points.select(F.explode(F.array(*(F.struct(F.lit(p).alias("path"), F.transform(compiled_leaves(F.col(payload), p), F.schema_of_variant).alias("kinds")) for p in paths))).alias("r"))
    rows = read.select("r.path", F.explode_outer("r.kinds").alias("kind"))
    of = F.expr("'numbers'")
    for name, pattern in reversed(kinds.items()):
        of = F.when(F.col("kind").rlike(pattern), name).otherwise(of)
    counted = rows.withColumn("of", F.when(F.col("kind").isNotNull(), of)).groupBy("path").agg(F.count("of").alias("leaves"), *(F.count_if(F.col("of") == k).alias(k) for k in kinds))
    one = reduce(lambda a, b: a | b, (F.col(k) == F.col("leaves") for k in kinds))
    return counted.select("path", "leaves", *kinds, one.alias("homogeneous"))


def _decided(condition: Condition, indexes: dict[str, Indexed]) -> Column | None:
    """Whether a row satisfies the condition, for rows of which the indexes tell all leaves; None if they can't tell."""
    if isinstance(condition, Filter):
        of = lambda cs: [_decided(c, indexes) for c in cs]
        must, should, must_not = of(condition.must), of(condition.should), of(condition.must_not)
        if any(c is None for c in (*must, *should, *must_not)):
            return None
        return reduce(lambda a, b: a & b, [*must, *([reduce(lambda a, b: a | b, should)] if should else []), *(~c for c in must_not)], F.lit(True))
    index = indexes.get(getattr(condition, "path", ""))
    if index is None:
        return None
    if isinstance(condition, Match):
        found = _match(index, condition.value)
    elif index.schema == PayloadSchema.FLOAT:
        bounds = ((condition.gt, "__gt__"), (condition.gte, "__ge__"), (condition.lt, "__lt__"), (condition.lte, "__le__"))
        if any(b is not None and (abs(b) > sys.float_info.max or float(b) != b) for b, _ in bounds):
            return None
        found = reduce(lambda a, b: a & b, (getattr(F.col(index.value), op)(F.lit(float(b))) for b, op in bounds if b is not None))
    else:
        found = _range(index, condition)
    return F.lit(False) if found is None else F.coalesce(found, F.lit(False))


def cardinality(points: DataFrame, condition: Condition, indexes: dict[str, Indexed]) -> DataFrame:
    """One row: minimum, expected, maximum, exact. Rows with leaves that the indexes don't tell may satisfy the condition
    or not; where the condition has a path without an index, none or all may, and half are expected."""
    decided, n = _decided(condition, indexes), F.count("*")
    if decided is None:
        return points.agg(F.lit(0).cast("long").alias("minimum"), F.floor(n / 2).alias("expected"), n.alias("maximum"), F.lit(False).alias("exact"))
    open_ = reduce(lambda a, b: a | b, (F.col(i.other) for i in indexes.values()), F.lit(False))
    found = points.agg(F.count_if(decided & ~open_).alias("minimum"), F.count_if(open_).alias("open"))
    return found.select("minimum", (F.col("minimum") + F.floor(F.col("open") / 2)).alias("expected"), (F.col("minimum") + F.col("open")).alias("maximum"), (F.col("open") == 0).alias("exact"))
