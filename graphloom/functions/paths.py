"""Fields of a triple as typed columns.

Envelope names are columns; other names are paths into `data`.  Values are
compared within one type only: a number never equals a string that looks like it.

Numbers are compared as doubles with any number under 2**53, which is exact for integers;
with larger ones and with decimals they are compared as decimals of 38 digits.
"""

from __future__ import annotations

import datetime
import decimal
import json
import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import invalid
from graphloom.model import ENVELOPE

_SEGMENT = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*")
_CLASSES = {"number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT"), "string": ("STRING",), "boolean": ("BOOLEAN",), "array": ("ARRAY",)}


def data_path(field: str, bare: bool = True) -> str | None:
    """The JSON path of a field in data, `$` for all of data, None for envelope fields."""
    if field in ENVELOPE:
        return None
    parts = field.split(".")
    if parts[0] == "data":
        parts = parts[1:]
    elif not bare:
        raise invalid(f"{field!r} isn't an envelope field; write data.{field}")
    if not all(_SEGMENT.fullmatch(p) for p in parts):
        raise invalid(f"{field!r} isn't a field path")
    return ".".join(["$", *parts])


#: The least number that a double can't tell from its neighbours.
EXACT = 1 << 53
#: Elements from which a list is joined as a table instead of written into the condition.
LONG_LIST = 1_000


def kind_of(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int | float | decimal.Decimal):
        return "number"
    if isinstance(value, list | dict):
        return "json"
    return "string"


def variant_at(path: str) -> Column:
    return F.try_variant_get("data", path, "variant")


def typed(path: str, kind: str) -> Column:
    """The value at a path where it is of the kind, else null."""
    v = variant_at(path)
    shape = F.schema_of_variant(v)
    is_kind = F.lit(False)
    for name in _CLASSES[kind]:
        is_kind = is_kind | shape.startswith(name)
    spark_type = {"number": "double", "string": "string", "boolean": "boolean", "array": "array<variant>"}[kind]
    return F.when(is_kind, F.try_variant_get("data", path, spark_type))


def exact(path: str, digits: int = 0) -> Column:
    """The number at a path as a decimal with that many digits after the point, else null: without loss for integers
    and decimals that fit, and for doubles beyond 2**53, which are whole."""
    if not 0 <= digits <= 38:
        raise invalid("a decimal has 0 to 38 digits after its point")
    v = variant_at(path)
    shape = F.schema_of_variant(v)
    whole = reduce(Column.__or__, [shape.startswith(c) for c in ("BIGINT", "DECIMAL", "INT", "SMALLINT", "TINYINT")])
    kind = f"decimal(38,{digits})"
    return F.when(whole, F.try_variant_get("data", path, kind)).when(shape.startswith("DOUBLE") | shape.startswith("FLOAT"), F.try_variant_get("data", path, "double").try_cast(kind))


def is_large(value: object) -> bool:
    """Whether doubles can't tell a number from others near it."""
    return isinstance(value, decimal.Decimal) or kind_of(value) == "number" and abs(value) >= EXACT


_COMPARE: dict[str, Callable[[Column, Column], Column]] = {"==": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}


def _decimal(value: object) -> tuple[decimal.Decimal, int]:
    """A large number as a decimal, and the digits after the point that fields are compared with it by: at least 18 up to 10**20."""
    given = value if isinstance(value, decimal.Decimal) else decimal.Decimal(value)
    if not given.is_finite():
        raise invalid("numbers must be finite")
    return given, 38 - max(20, given.adjusted() + 1)


def _compared(path: str, op: str, value: object) -> Column:
    """A number at a path against a large one or a decimal; as doubles where the field doesn't fit, as it is far larger then."""
    given, digits = _decimal(value)
    as_double = _COMPARE[op](typed(path, "number"), F.lit(float(given)))
    if digits < 0:
        return as_double
    found = exact(path, digits)
    return F.when(found.isNull(), as_double).otherwise(_COMPARE[op](found, F.lit(f"{given:f}").cast(f"decimal(38,{digits})")))


def _among(path: str, values: list) -> Column:
    """Whether a number at a path is one of large ones."""
    by_digits: dict[int, list] = {}
    for given, digits in map(_decimal, values):
        by_digits.setdefault(digits, []).append(given)
    hits = F.lit(False)
    for digits, vs in by_digits.items():
        found = typed(path, "number").isin([float(v) for v in vs]) if digits < 0 else exact(path, digits).isin(*[F.lit(f"{v:f}").cast(f"decimal(38,{digits})") for v in vs])
        hits = hits | F.coalesce(found, F.lit(False))
    return hits


def literal(value: object) -> Column:
    if isinstance(value, float) and not math.isfinite(value):
        raise invalid("numbers must be finite")
    if isinstance(value, datetime.datetime):
        return F.lit(value.isoformat())
    if isinstance(value, bytes) or callable(value):
        raise invalid(f"{type(value).__name__} can't be compared")
    if isinstance(value, list | dict):
        return F.lit(json.dumps(value, separators=(",", ":"), sort_keys=True))
    if kind_of(value) == "number":
        return F.lit(float(value))
    return F.lit(value)


def field(name: str, value: object, bare: bool = True) -> Column:
    """The column of a field, typed as values like `value` are."""
    path = data_path(name, bare)
    if path is None:
        return F.col(name)
    kind = kind_of(value)
    return F.to_json(variant_at(path)) if kind == "json" else typed(path, kind)


def predicate(name: str, op: str, value: object) -> Column:
    """One filter as a column; null where the field has no value of its type."""
    envelope = data_path(name) is None
    lit = F.lit if envelope else literal
    if op in ("in", "not-in", "array-contains-any"):
        hits = F.lit(False)
        for kind, vs in _by_kind(op, value).items():
            if kind == "large" and not envelope:
                if op == "array-contains-any":
                    items = F.transform(typed(data_path(name), "array"), lambda v: F.try_variant_get(v, "$", "decimal(38,0)"))
                    hits = hits | F.coalesce(F.arrays_overlap(items, F.array(*[F.lit(str(int(v))).cast("decimal(38,0)") for v in vs])), F.lit(False))
                else:
                    hits = hits | _among(data_path(name), vs)
                continue
            if op == "array-contains-any":
                hits = hits | F.coalesce(F.arrays_overlap(_elements(name, vs[0]), F.array(*map(lit, vs))), F.lit(False))
            else:
                hits = hits | F.coalesce(field(name, vs[0]).isin(*map(lit, vs)), F.lit(False))
        if op == "not-in":
            return _there(name) & ~hits
        return hits
    if value is None:
        return F.lit(False)
    if op == "array-contains":
        return F.coalesce(F.array_contains(_elements(name, value), lit(value)), F.lit(False))
    if op not in _COMPARE:
        raise invalid(f"unknown operator {op!r}")
    met = _compared(data_path(name), op, value) if not envelope and is_large(value) else _COMPARE[op](field(name, value), lit(value))
    return _there(name) & F.coalesce(met, F.lit(True)) if op == "!=" and not envelope else met


def _there(name: str) -> Column:
    """Whether a field has a value other than null."""
    path = data_path(name)
    return F.col(name).isNotNull() if path is None else F.coalesce(F.schema_of_variant(variant_at(path)) != "VOID", F.lit(False))


def _by_kind(op: str, value: object) -> dict[str, list]:
    """The elements of a list by their kinds, large numbers apart."""
    if not isinstance(value, list) or not value:
        raise invalid(f"{op} needs a list with elements")
    kinds: dict[str, list] = {}
    for v in value:
        kinds.setdefault("large" if is_large(v) else kind_of(v), []).append(v)
    return kinds


def is_long(op: str, value: object) -> bool:
    return op in ("in", "not-in") and isinstance(value, list) and len(value) >= LONG_LIST


def matched(df: DataFrame, name: str, op: str, value: object) -> DataFrame:
    """The rows of df that meet one filter; a long list is joined as a table for each kind of its elements.

    Each element marks the rows that have it once, so a row with no value, or one of another kind, isn't
    in the list, and is outside of it if it has a value at all.
    """
    if not is_long(op, value):
        return df.where(predicate(name, op, value))
    envelope, columns, hits = data_path(name) is None, df.columns, F.lit(False)
    for i, (kind, vs) in enumerate(_by_kind(op, value).items()):
        if envelope:
            key, values, shape = F.col(name), vs, df.schema[name].dataType.simpleString()
        elif kind == "large":
            fit = [given for given, digits in map(_decimal, vs) if digits == 18]
            if len(fit) < len(vs):
                hits = hits | _among(data_path(name), [v for v in vs if _decimal(v)[1] < 18])
            key, values, shape = exact(data_path(name), 18), fit, "decimal(38,18)"
        else:
            key, shape = field(name, vs[0]), {"number": "double", "boolean": "boolean"}.get(kind, "string")
            values = [float(v) if kind == "number" else json.dumps(v, separators=(",", ":"), sort_keys=True) if kind == "json" else v.isoformat() if isinstance(v, datetime.datetime) else v for v in vs]
        listed = df.sparkSession.createDataFrame([(v, True) for v in dict.fromkeys(values)], f"_v{i} {shape}, _m{i} boolean")
        df = df.join(listed, key == F.col(f"_v{i}"), "left")
        hits = hits | F.coalesce(f"_m{i}", F.lit(False))
    return df.where(hits if op == "in" else _there(name) & ~hits).select(*columns)


def _elements(name: str, like: object) -> Column:
    path = data_path(name)
    if path is None:
        raise invalid(f"{name} isn't an array")
    kind = {"number": "double", "string": "string", "boolean": "boolean", "json": "string"}[kind_of(like)]
    return F.transform(typed(path, "array"), lambda v: F.try_variant_get(v, "$", kind))
