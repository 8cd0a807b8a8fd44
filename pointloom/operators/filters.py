"""Boolean filters over nested payloads, compiled to Spark columns over VARIANT.

A path such as a.b resolves to leaves: objects are entered by key, arrays are expanded wherever they stand. A condition
holds if any leaf satisfies it, so two conditions may be met by different elements of one array. An explicit null is a
leaf; a missing key has none.
"""

from __future__ import annotations

import math
import operator
import sys
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from numbers import Real
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom import ids
from pointloom.errors import InvalidFilterError, InvalidPointError


def _path(path: str) -> list[str]:
    if not isinstance(path, str) or not all(parts := path.split(".")):
        raise InvalidFilterError(f"a path needs names between its dots: {path!r}")
    return parts


@dataclass(frozen=True)
class Match:
    """Some leaf equals the value, as Python compares: 1, 1.0 and True are equal."""

    path: str
    value: None | bool | int | float | str

    def __post_init__(self) -> None:
        _path(self.path)
        if not (self.value is None or isinstance(self.value, (bool, int, float, str))) or (isinstance(self.value, float) and not math.isfinite(self.value)):
            raise InvalidFilterError(f"not a finite JSON scalar: {self.value!r}")


@dataclass(frozen=True)
class Range:
    """Some leaf is a number, not a boolean, within all bounds."""

    path: str
    gt: float | None = None
    gte: float | None = None
    lt: float | None = None
    lte: float | None = None

    def __post_init__(self) -> None:
        _path(self.path)
        bounds = [b for b in (self.gt, self.gte, self.lt, self.lte) if b is not None]
        if not bounds or any(isinstance(b, bool) or not isinstance(b, Real) or (isinstance(b, float) and not math.isfinite(b)) for b in bounds):
            raise InvalidFilterError("a range needs finite bounds, one at least")
        lows, highs = [b for b in (self.gt, self.gte) if b is not None], [b for b in (self.lt, self.lte) if b is not None]
        if lows and highs and max(lows) > min(highs):
            raise InvalidFilterError("the lower bound is above the upper one")
        if len(lows) == 2 or len(highs) == 2:
            raise InvalidFilterError("give gt or gte, lt or lte")


@dataclass(frozen=True)
class HasId:
    ids: tuple[Any, ...]

    def __init__(self, values) -> None:
        try:
            found = tuple(dict.fromkeys(ids.canonical(v) for v in values))
        except InvalidPointError as e:
            raise InvalidFilterError(str(e)) from e
        if not found:
            raise InvalidFilterError("no ids")
        object.__setattr__(self, "ids", found)


@dataclass(frozen=True)
class Filter:
    """All of must, none of must_not and, if there is any, one of should. Filters nest."""

    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()

    def __post_init__(self) -> None:
        for name in ("must", "should", "must_not"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
            if not all(isinstance(c, (Match, Range, HasId, Filter)) for c in getattr(self, name)):
                raise InvalidFilterError(f"not a condition in {name}")


Condition = Match | Range | HasId | Filter


# -- one payload, in Python: what the compiled form is held against


def leaves(payload: Any, path: str) -> list[Any]:
    found = [payload]
    for name in [*_path(path), None]:
        flat: list[Any] = []
        while found:
            x = found.pop(0)
            if isinstance(x, (list, tuple)):
                found[:0] = list(x)
            else:
                flat.append(x)
        if name is None:
            return flat
        found = [x[name] for x in flat if isinstance(x, dict) and name in x]
    return found


def matches_filter(condition: Condition, point_id: object, payload: dict) -> bool:
    if isinstance(condition, Filter):
        holds = lambda cs: [matches_filter(c, point_id, payload) for c in cs]
        return all(holds(condition.must)) and not any(holds(condition.must_not)) and (not condition.should or any(holds(condition.should)))
    if isinstance(condition, HasId):
        return ids.canonical(point_id) in condition.ids
    found = leaves(payload, condition.path)
    if isinstance(condition, Match):
        return any(x == condition.value and (x is None) == (condition.value is None) for x in found)
    within = lambda x: all((condition.gt is None or x > condition.gt, condition.gte is None or x >= condition.gte, condition.lt is None or x < condition.lt, condition.lte is None or x <= condition.lte))
    return any(isinstance(x, Real) and not isinstance(x, bool) and within(x) for x in found)


# -- compiled


def _expanded(found: Column) -> Column:
    """An array of variants, with arrays among them, however deep, replaced by their elements."""
    is_array = lambda x: F.schema_of_variant(x).startswith("ARRAY")
    opened = lambda xs: F.flatten(F.transform(xs, lambda x: F.coalesce(F.when(is_array(x), F.try_variant_get(x, "$", "array<variant>")), F.array(x))))
    brackets = lambda x: F.length(F.to_json(x)) - F.length(F.replace(F.to_json(x), F.lit("["), F.lit("")))

    def all_opened(xs: Column) -> Column:
        most = F.array_max(F.transform(xs, brackets))  # no value is deeper than its brackets are many
        return F.aggregate(F.sequence(F.lit(1), most), xs, lambda done, _: F.when(F.exists(done, is_array), opened(done)).otherwise(done))

    once = F.transform(F.array(found), lambda xs: F.when(F.exists(xs, is_array), all_opened(xs)).otherwise(xs))
    return F.get(once, F.lit(0))


def _getter(name: str):
    """Of a key; one with both kinds of quotes is no path of Spark's, and is looked up in a map."""
    if "'" in name and '"' in name:
        return lambda x: F.try_element_at(F.try_variant_get(x, "$", "map<string,variant>"), F.lit(name))
    at = f"$['{name}']" if "'" not in name else f'$["{name}"]'
    return lambda x: F.try_variant_get(x, at, "variant")


def compiled_leaves(payload: Column, path: str) -> Column:
    found = _expanded(F.array(payload))
    for name in _path(path):
        # Only an object has keys: try_variant_get of a scalar or an array gives NULL, which is no leaf.
        found = _expanded(F.filter(F.transform(found, _getter(name)), lambda x: x.isNotNull()))
    return found


#: Whole numbers of a payload are below this, and all numbers at most this.
WHOLE, _LARGEST = 10**37, sys.float_info.max


def _number(x: Column) -> Column:
    """The leaf as a double, null unless it is a number."""
    kind = F.schema_of_variant(x)
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(x, "$", "double"))


def _equal(x: Column, value: None | bool | float | str) -> Column:
    if value is None:
        return F.is_variant_null(x)
    kind = F.schema_of_variant(x)
    if isinstance(value, str):
        return (kind == "STRING") & (F.try_variant_get(x, "$", "string") == value)
    if abs(value) > _LARGEST:  # of any number here
        return F.lit(False)
    same = _number(x) == float(value) if float(value) == value else F.lit(False)
    if value == int(value) and abs(value) < WHOLE:  # doubles would not tell large ones apart
        whole = kind.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))")
        same = F.when(whole, F.try_variant_get(x, "$", "decimal(38,0)") == F.lit(str(int(value))).cast("decimal(38,0)")).otherwise(same)
    as_bool = (kind == "BOOLEAN") & (F.try_variant_get(x, "$", "boolean") == bool(value)) if value in (0, 1) else F.lit(False)
    return F.coalesce(same, F.lit(False)) | F.coalesce(as_bool, F.lit(False))


def compile_filter(condition: Condition, payload: Column | None, key: Column) -> Column:
    """A boolean column, never null. `payload` is a VARIANT column, `key` one of ids.key."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    if isinstance(condition, Filter):
        parts = lambda cs: [compile_filter(c, payload, key) for c in cs]
        out = reduce(lambda a, b: a & b, parts(condition.must), F.lit(True))
        if condition.should:
            out &= reduce(lambda a, b: a | b, parts(condition.should))
        return reduce(lambda a, b: a & ~b, parts(condition.must_not), out)
    if isinstance(condition, HasId):
        return sure(key.isin([ids.key(i) for i in condition.ids]))
    found = compiled_leaves(payload, condition.path)
    if isinstance(condition, Match):
        return sure(F.exists(found, lambda x: F.coalesce(_equal(x, condition.value), F.lit(False))))

    def within(x: Column) -> Column:
        n, whole = _number(x), F.try_variant_get(x, "$", "decimal(38,0)")
        is_whole = F.schema_of_variant(x).rlike(r"^(BIGINT|DECIMAL\(\d+,0\))")

        def holds(bound: float | None, op: Callable, rounded: Callable) -> Column:
            if bound is None:
                return F.lit(True)
            beyond = abs(bound) >= WHOLE  # of any whole number here
            near = float(bound) if abs(bound) <= _LARGEST else math.inf if bound > 0 else -math.inf
            up, exactly = op in (operator.gt, operator.ge), near == bound  # a whole bound may lie between two doubles
            as_double = (op if exactly else (operator.ge if near > bound else operator.gt) if up else (operator.lt if near > bound else operator.le))(n, F.lit(near))
            return as_double if beyond else F.when(is_whole, op(whole, F.lit(str(rounded(bound))).cast("decimal(38,0)"))).otherwise(as_double)

        # A whole number is above b if and only if it is above b rounded down, and so on: doubles would not tell large ones apart.
        parts = (holds(condition.gt, operator.gt, math.floor), holds(condition.gte, operator.ge, math.ceil), holds(condition.lt, operator.lt, math.ceil), holds(condition.lte, operator.le, math.floor))
        return F.coalesce(reduce(operator.and_, parts), F.lit(False))

    return sure(F.exists(found, within))


# -- typed payloads


def compile_typed(condition: Condition, payload: Column, kind: T.DataType, key: Column) -> Column:
    """The condition over a payload of nested structs and arrays, for a Filter or where(): true where it holds, else false
    or null. Paths become nested columns, so Parquet reads only these, and skips row groups by conditions on those
    outside of arrays. A null field is an explicit null, unless the struct around it is null: then it is missing. What
    has another type than its condition's value does not satisfy it; VARIANT parts are read as in compile_filter."""
    if isinstance(condition, Filter):
        of = lambda cs: [compile_typed(c, payload, kind, key) for c in cs]
        parts = [*of(condition.must), *([reduce(operator.or_, of(condition.should))] if condition.should else [])]
        parts += [~F.coalesce(c, F.lit(False)) for c in of(condition.must_not)]
        return reduce(operator.and_, parts) if parts else F.lit(True)
    if isinstance(condition, HasId):
        return key.isin([ids.key(i) for i in condition.ids])
    return _typed(payload, kind, _path(condition.path), condition)


def _typed(x: Column, kind: T.DataType, names: list[str], condition: Match | Range) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.exists(x, lambda e: F.coalesce(_typed(e, kind.elementType, names, condition), F.lit(False)))
    if isinstance(kind, T.VariantType):
        at = {"path": ".".join(names)} if names else {}
        return compile_filter(replace(condition, **at), x, F.lit("")) if names else F.lit(False)
    if names:
        if not isinstance(kind, T.StructType) or names[0] not in kind.names:
            return F.lit(False)
        found = _typed(x.getField(names[0]), kind[names[0]].dataType, names[1:], condition)
        is_null = isinstance(condition, Match) and condition.value is None and len(names) == 1
        return x.isNotNull() & found if is_null else found
    if isinstance(condition, Range):
        if not isinstance(kind, T.NumericType):
            return F.lit(False)
        return reduce(operator.and_, (_bounded(x, kind, b, op) for b, op in ((condition.gt, operator.gt), (condition.gte, operator.ge), (condition.lt, operator.lt), (condition.lte, operator.le)) if b is not None))
    value = condition.value
    if value is None:
        return x.isNull()
    if isinstance(value, str):
        return x == F.lit(value) if isinstance(kind, T.StringType) else F.lit(False)
    if isinstance(kind, T.BooleanType):
        return x == F.lit(bool(value)) if value in (0, 1) else F.lit(False)
    if not isinstance(kind, T.NumericType):
        return F.lit(False)
    return _bounded(x, kind, value, operator.ge) & _bounded(x, kind, value, operator.le) if isinstance(kind, T.IntegralType) and value != int(value) else _bounded(x, kind, value, operator.eq)


_BITS = {"byte": 7, "short": 15, "integer": 31, "long": 63}


def _bounded(x: Column, kind: T.DataType, bound: float, op: Callable) -> Column:
    """op(x, bound), in x's own type if it is integral, so that it can be pushed down."""
    if not isinstance(kind, T.IntegralType):
        return op(x, F.lit(float(bound))) if abs(bound) <= _LARGEST else F.lit((bound > 0) == (op in (operator.lt, operator.le)))
    least, most = -(1 << _BITS[kind.typeName()]), (1 << _BITS[kind.typeName()]) - 1
    whole = {operator.gt: math.floor, operator.ge: math.ceil, operator.lt: math.ceil, operator.le: math.floor, operator.eq: int}[op](bound)
    if least <= whole <= most:
        return op(x, F.lit(whole).cast(kind))
    always = op in ((operator.gt, operator.ge) if whole < least else (operator.lt, operator.le))
    return x.isNotNull() if always else F.lit(False)
