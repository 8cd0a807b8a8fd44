"""Point ids: unsigned 64-bit integers or UUIDs. In tables they are strings whose order is the ids' order: integers
first, as 20 digits after `i`, then UUIDs in canonical form after `u`."""

from __future__ import annotations

from uuid import UUID

from pyspark.sql import Column
from pyspark.sql import functions as F

from pointloom.errors import InvalidPointError

PointId = int | str


def canonical(value: object) -> PointId:
    if isinstance(value, int) and not isinstance(value, bool) and 0 <= value < 1 << 64:
        return value
    try:
        if isinstance(value, UUID):
            return str(value)
        if isinstance(value, str) and value:
            return str(UUID(value))
    except ValueError:
        pass
    raise InvalidPointError(f"not an unsigned 64-bit integer or a UUID: {value!r}")


def key(value: object) -> str:
    value = canonical(value)
    return f"i{value:020d}" if isinstance(value, int) else f"u{value}"


def from_key(text: str) -> PointId:
    return int(text[1:]) if text[0] == "i" else text[1:]


def key_of_integers(column: Column) -> Column:
    return F.concat(F.lit("i"), F.lpad(column.cast("decimal(20,0)").cast("string"), 20, "0"))


_TOO_LARGE = str(1 << 64)


def key_of(column: Column) -> Column:
    """Keys of ids of both kinds: whole numbers, or texts of decimal digits (of an unsigned 64-bit number) or of a UUID in any
    of its usual forms. Null for what is no id."""
    text = F.trim(column.cast("string"))
    number = F.when(text.rlike("^0*[0-9]{1,20}$"), F.lpad(F.regexp_replace(text, "^0+(?=.)", ""), 20, "0"))
    digits = F.regexp_replace(F.lower(text), "^urn:uuid:|[{}-]", "")
    parts = [F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    uuid = F.when(digits.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *parts))
    return F.when(number < F.lit(_TOO_LARGE), F.concat(F.lit("i"), number)).when(number.isNull() & uuid.isNotNull(), F.concat(F.lit("u"), uuid))


def shown(keys: Column) -> Column:
    """The ids of keys, as texts."""
    text = F.substring(keys, 2, 36)
    return F.when(keys.startswith("i"), F.regexp_replace(text, "^0+(?=.)", "")).otherwise(text)
