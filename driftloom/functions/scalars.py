"""Column expressions with the edge cases of the string, byte and time helpers that they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_blank(c: Column) -> Column:
    """All white space; the empty string is."""
    return c.rlike(r"^\s*$")


def starts_with(c: Column, what: str) -> Column:
    """False for an empty pattern."""
    return c.startswith(what) if what else F.lit(False)


def ends_with(c: Column, what: str) -> Column:
    return c.endswith(what) if what else F.lit(False)


def contains(c: Column, what: str) -> Column:
    """True for an empty pattern."""
    return c.contains(what)


def remove_first(c: Column, what: str) -> Column:
    at = F.instr(c, what)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + len(what), F.length(c)))).otherwise(c)


def is_digits(c: Column) -> Column:
    """False for the empty string, and for one that ends a line."""
    return c.rlike(r"\A[0-9]+\z")


def list_text(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))


def to_hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def from_hex(c: Column) -> Column:
    """Null for an odd number of digits."""
    return F.when(F.length(c) % 2 == 0, F.unhex(c))


def int_hex(c: Column, width: int = 8) -> Column:
    """At least `width` digits, two for each byte of the type (8 for int, 16 for long); longer numbers are not cut."""
    digits = F.lower(F.hex(c))
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.length(digits), F.lit(0))), digits)


def trim_zeros(c: Column) -> Column:
    """Bytes without trailing zeros."""
    return F.unhex(F.regexp_replace(F.hex(c), "(00)+$", ""))


def truncate(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def function_name(user: Column, function: Column, app: Column | None = None) -> Column:
    """user/function, with :app where there is one."""
    name = F.concat_ws("/", user, function)
    return name if app is None else F.when(app.isNotNull(), F.concat_ws(":", name, app)).otherwise(name)


def state_key(user: Column, key: Column) -> Column:
    return F.concat_ws("_", user, key)


def command_line(first: str, text: Column) -> Column:
    """The words of a command line, split at single spaces, after a fixed first element."""
    return F.array_insert(F.split(text, " "), 1, F.lit(first))


def millis(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))


def nanos(seconds: Column, rest: Column) -> Column:
    return seconds * 1_000_000_000 + rest


def seconds_and_nanos(n: Column) -> tuple[Column, Column]:
    """Whole seconds, towards minus infinity, and the nanoseconds after them; by whole numbers, as doubles round."""
    rest = F.pmod(n, F.lit(1_000_000_000).cast("long"))
    return F.call_function("div", n - rest, F.lit(1_000_000_000).cast("long")), rest


def timer_report(timers: DataFrame) -> DataFrame:
    """(label, total, average, count) of (label, micros), ascending by total."""
    return timers.groupBy("label").agg(F.sum("micros").alias("total"), F.avg("micros").alias("average"), F.count("*").alias("count")).orderBy("total", "label")
