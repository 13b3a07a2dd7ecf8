"""Three-valued logic and checked arithmetic over columns.

A value is a struct (tag, truth, number). tag is one of truth, number, unknown, error. Known truth values follow Kleene;
an unknown of no type absorbs them; an error absorbs all.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def value(tag: Column, truth: Column | None = None, number: Column | None = None) -> Column:
    return F.struct(tag.alias("tag"), (truth if truth is not None else F.lit(None).cast("boolean")).alias("truth"), (number if number is not None else F.lit(None).cast("long")).alias("number"))


def truth(c: Column) -> Column:
    """A truth value; null is a truth value that isn't known."""
    return value(F.lit("truth"), truth=c)


def number(c: Column) -> Column:
    return value(F.lit("number"), number=c.cast("long"))


def _spread(a: Column, b: Column, on: Column) -> Column:
    return F.when((a["tag"] == "error") | (b["tag"] == "error"), value(F.lit("error"))).when((a["tag"] == "unknown") | (b["tag"] == "unknown"), value(F.lit("unknown"))).otherwise(on)


def both(a: Column, b: Column) -> Column:
    bits = value(F.lit("number"), number=a["number"].bitwiseAND(b["number"]))
    return _spread(a, b, F.when((a["tag"] == "truth") & (b["tag"] == "truth"), truth(a["truth"] & b["truth"])).when((a["tag"] == "number") & (b["tag"] == "number"), bits).otherwise(value(F.lit("error"))))


def either(a: Column, b: Column) -> Column:
    bits = value(F.lit("number"), number=a["number"].bitwiseOR(b["number"]))
    return _spread(a, b, F.when((a["tag"] == "truth") & (b["tag"] == "truth"), truth(a["truth"] | b["truth"])).when((a["tag"] == "number") & (b["tag"] == "number"), bits).otherwise(value(F.lit("error"))))


def negated(a: Column) -> Column:
    return F.when(a["tag"] == "truth", truth(~a["truth"])).when(a["tag"] == "number", value(F.lit("number"), number=-a["number"] - 1)).otherwise(a)


def checked(op: str, a: Column, b: Column) -> Column:
    """a op b on longs: null where the result overflows, divides by zero or shifts outside 0 to 63."""
    inside = b.between(0, 63)
    return {
        "+": lambda: F.try_add(a, b),
        "-": lambda: F.try_subtract(a, b),
        "*": lambda: F.try_multiply(a, b),
        "div": lambda: F.when((b != 0) & ~((b == -1) & (a == F.lit(-(1 << 63)))), F.call_function("div", a, b)),
        "mod": lambda: F.try_mod(a, b),
        "shl": lambda: F.when(inside, F.call_function("shiftleft", a, b.cast("int"))),
        "shr": lambda: F.when(inside, F.call_function("shiftright", a, b.cast("int"))),
    }[op]()
