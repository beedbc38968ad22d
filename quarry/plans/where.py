"""Filters as columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates, geo
from ..sources.index import Field, Index
from .params import SearchError

NUMBER = ("eq", "gt", "gte", "lt", "lte", "between")
#: Whole numbers up to this one are doubles without loss.
EXACT = 1 << 53


def compile_where(index: Index, where: dict, top: bool = True) -> Column:
    """A column for ``DataFrame.where``: null counts as false. Fields, ``and``, ``or`` and
    ``not`` of a node all hold together; a node with an unknown field matches nothing, as does
    an empty node but for the outermost; a filter of another type than its field matches
    nothing; ``not`` matches documents that lack the field.

    Tests are plain comparisons of columns with literals, so that they reach the scan; only
    what stands under ``not`` is made false where it is null.
    """
    if not where:
        return F.lit(top)
    out: Column | None = None

    def also(c: Column) -> None:
        nonlocal out
        out = c if out is None else out & c

    for name, value in where.items():
        if name in ("and", "or", "not"):
            continue
        fields = index.filters.get(name)
        if fields is None:
            return F.lit(False)
        also(clause(fields, value))
    for child in where.get("and") or []:
        also(compile_where(index, child, False))
    if "or" in where and where["or"] is not None:
        any_of = F.lit(False)
        for child in where["or"]:
            any_of = any_of | compile_where(index, child, False)
        also(any_of)
    if where.get("not") is not None:
        also(~F.coalesce(compile_where(index, where["not"], False), F.lit(False)))
    return F.lit(False) if out is None else out


def clause(field: Field, value) -> Column:
    kind, test = literal(value, field)
    if field.kind != kind:
        return F.lit(False)
    if field.array:
        return F.exists(field.column, lambda x: F.coalesce(test(x), F.lit(False)))
    return test(field.column)


def literal(value, field: Field) -> tuple[str, Callable[[Column], Column]]:
    """(kind of field it is for, test of a value). Operator objects of date texts are for
    dates, of numbers for numbers; a bare text is always for strings."""
    if isinstance(value, bool):
        return "bool", lambda c: c == F.lit(value)
    if isinstance(value, str):
        if field.kind == "string" and field.raw is not None and not field.array:  # the literal's own length tells
            return "string", lambda c: (field.raw == F.lit(value)) if field.admits(value) else F.lit(False)
        return "string", lambda c: c == F.lit(value)
    if isinstance(value, dict) and len(value) == 1:
        op, arg = next(iter(value.items()))
        if op in NUMBER:
            args = arg if op == "between" else [arg]
            if not isinstance(args, list) or (op == "between" and len(args) != 2):
                raise SearchError(f"{op} needs {'two values' if op == 'between' else 'a value'}")
            if all(isinstance(a, (int, float)) and not isinstance(a, bool) for a in args):
                return "number", lambda c: number(c, op, args, field)
            if all(isinstance(a, str) for a in args):
                parsed = [dates.parse(a) for a in args]
                if None not in parsed:
                    return "date", lambda c: date(c, op, parsed)
        if op == "radius":
            at, r = arg["coordinates"], geo.metres(float(arg["value"]), arg.get("unit", "m"))
            near = lambda c: geo.within(c["lat"], c["lon"], float(at["lat"]), float(at["lon"]), r)
            return "geo", near if arg.get("inside", True) else lambda c: ~near(c)
        if op == "polygon":
            points = [(float(p["lat"]), float(p["lon"])) for p in arg["coordinates"]]
            inside = lambda c: geo.in_polygon(c["lat"], c["lon"], points)
            return "geo", inside if arg.get("inside", True) else lambda c: ~inside(c)
    raise SearchError(f"no filter {value!r}")


def both(c: Column, op: str, args: list, test: Callable[[Column, str, object], Column]) -> Column:
    return test(c, "gte", args[0]) & test(c, "lte", args[1]) if op == "between" else test(c, op, args[0])


def compare(c: Column, op: str, x) -> Column:
    return {"eq": c == x, "gt": c > x, "gte": c >= x, "lt": c < x, "lte": c <= x}[op]


def whole_number(c: Column, op: str, x) -> Column:
    """A column of whole numbers against any number, without a detour through doubles."""
    if math.isnan(x):
        return compare(c.cast("double"), op, F.lit(float(x)))
    if op == "eq":
        return c == F.lit(int(x)) if math.isfinite(x) and x == int(x) and abs(x) < 1 << 63 else F.lit(False)
    if not math.isfinite(x) or abs(x) >= 1 << 63:
        return (c.isNotNull()) if (x > 0) == (op in ("lt", "lte")) else F.lit(False)
    low, high = math.floor(x), math.ceil(x)
    return {"gt": c > F.lit(low), "gte": c >= F.lit(high), "lt": c < F.lit(high), "lte": c <= F.lit(low)}[op]


def number(c: Column, op: str, args: list, field: Field) -> Column:
    """A whole-number column is compared as such; a double also with ``field.whole``, its value
    where it is a whole number, where doubles can't tell numbers apart."""
    if field.integral:
        return both(c, op, args, whole_number)

    def test(c: Column, op: str, x) -> Column:
        plain = compare(c, op, F.lit(float(x)))
        if abs(x) < EXACT or field.whole is None or field.array or math.isinf(x) or math.isnan(x):
            return plain
        wide = compare(c, {"gt": "gte", "lt": "lte"}.get(op, op), F.lit(float(x)))  # reaches the scan
        return wide & F.coalesce(whole_number(field.whole, op, x), plain)

    return both(c.cast("double") if field.array else c, op, args, test)


def date(c: Column, op: str, args: list[int]) -> Column:
    """In whole milliseconds: a moment is the millisecond that it lies in."""

    def test(c: Column, op: str, ms: int) -> Column:
        this, after = F.timestamp_millis(F.lit(ms)), F.timestamp_millis(F.lit(ms + 1))
        return {"eq": (c >= this) & (c < after), "gt": c >= after, "gte": c >= this, "lt": c < this, "lte": c < after}[op]

    return both(c, op, args, test)
