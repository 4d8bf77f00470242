"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def norm(c: Column) -> Column:
    """Trimmed lower-case text, empty for null: the form facets and counters compare."""
    return F.lower(strip(F.coalesce(c.cast("string"), F.lit(""))))


def truthy(c: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(c, F.lit(""))


def first_truthy(*cols: Column) -> Column:
    return F.coalesce(*[truthy(c) for c in cols])


def joined_text(*cols: Column) -> Column:
    """Lower-case text of several fields, null as empty, single spaces between."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols]))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    cond = F.lit(False)
    for word in words:
        cond = cond | text.contains(word)
    return cond


def first_match(text: Column, rules: Iterable[tuple[str, Iterable[str]]], default: str) -> Column:
    """Ordered keyword rules: the first class with any keyword in ``text`` wins."""
    out: Column | None = None
    for name, words in rules:
        cond = contains_any(text, words)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return F.lit(default) if out is None else out.otherwise(default)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a naive UTC timestamp (session zone is UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def parse_iso_utc(text: Column) -> Column:
    """ISO-8601 text to a naive UTC timestamp; anything else is null."""
    t = F.regexp_replace(strip(text), r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}),", "$1.")
    shaped = t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    return F.when(shaped, F.try_to_timestamp(t)).cast("timestamp_ntz")
