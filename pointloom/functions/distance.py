"""Scores between two columns of double arrays; higher is nearer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pointloom.config import Distance


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda x, y: x + y)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def negative_squared_euclid(a: Column, b: Column) -> Column:
    return F.lit(0.0) - _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """v at length 1; null for a zero vector."""
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: x / length))


def score(a: Column, b: Column, metric: Distance) -> Column:
    """For cosine, both sides are to be normalized."""
    return negative_squared_euclid(a, b) if metric == Distance.EUCLID else dot(a, b)


def _bound(value: Column, body) -> Column:
    """body(value), value being worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _two_sum(x: Column, y: Column, body) -> Column:
    """body(sum, error), which together are exactly x + y."""
    return _bound(x + y, lambda s: _bound(s - x, lambda part: body(s, (x - (s - part)) + (y - part))))


def exact_sum(terms: Column) -> Column:
    """The sum of finite doubles, rounded once. The terms are folded into parts that do not overlap and add up to exactly
    the sum so far, smallest first; these are added from the largest down, as far as they round."""
    none = F.array().cast("array<double>")

    def added(parts: Column, term: Column) -> Column:
        start = F.struct(term.alias("x"), none.alias("kept"))
        step = lambda state, part: _two_sum(state["x"], part, lambda s, error: F.struct(s.alias("x"), F.when(error == 0, state["kept"]).otherwise(F.concat(state["kept"], F.array(error))).alias("kept")))
        return F.aggregate(parts, start, step, lambda state: F.concat(state["kept"], F.array(state["x"])))

    nothing = F.lit(None).cast("double")
    start = F.struct(F.lit(0.0).alias("high"), F.lit(0.0).alias("low"), nothing.alias("beyond"))

    def down(state: Column, part: Column) -> Column:
        more = _two_sum(state["high"], part, lambda s, error: F.struct(s.alias("high"), error.alias("low"), nothing.alias("beyond")))
        return F.when(state["low"] == 0, more).otherwise(F.struct(state["high"].alias("high"), state["low"].alias("low"), F.coalesce(state["beyond"], part).alias("beyond")))

    def rounded(state: Column) -> Column:
        """Half an ulp was rounded to even; if more stands beyond it on the same side, it was more than half."""
        high, low = state["high"], state["low"]
        twice = high + 2 * low
        return F.when((low * F.coalesce(F.signum(state["beyond"]), F.lit(0.0)) > 0) & (twice - high == 2 * low), twice).otherwise(high)

    return F.aggregate(F.reverse(F.aggregate(terms, none, added)), start, down, rounded)


def strict_score(metric: Distance):
    """A function of two columns: the score whose sum is exact before its one rounding."""

    def measure(a: Column | str, b: Column | str) -> Column:
        if metric == Distance.EUCLID:
            return F.lit(0.0) - exact_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))
        return exact_sum(F.zip_with(a, b, lambda x, y: x * y))

    return measure
