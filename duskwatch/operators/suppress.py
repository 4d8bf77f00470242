"""Repeat suppression.

An alert is a repeat when an incident that was *kept* has the same source and title,
lies at most the window back, and equals it in every match field the alert has. A
field the alert lacks matches anything. Only kept incidents count, and a repeat does
not extend the window, so the result is a chain: each decision rests on earlier ones.

Two observations make the chain parallel without changing it:

* A kept incident can only match an alert on fields the incident has. Alerts that have
  all fields thus depend on nothing but their own kind, alerts lacking one depend on
  those and their own kind, and so on. Working from the most to the fewest fields,
  alerts hit by an incident of an earlier level are dropped first, and what is left is
  a plain chain per exact key.
* In a plain chain the next kept row is the first one later than the last kept row plus
  the window. A span of time therefore acts as a function from "last kept before" to
  "last kept in", which can be worked out per span, so even one key with a third of all
  rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskwatch.functions import rules
from duskwatch.functions.columns import micros, truthy
from duskwatch.operators.timecells import MICROS_PER_MINUTE, last_before
from duskwatch.session import cut_lineage

HOST_FIELDS = ("hostname", "source_ip", "username")
NETWORK_FIELDS = ("source_ip", "destination_ip")
FIELDS_BY_SENSOR = {rules.HOST_SENSOR: HOST_FIELDS, rules.NETWORK_SENSOR: NETWORK_FIELDS}
SPAN_US = 60 * MICROS_PER_MINUTE
_NEVER = np.iinfo(np.int64).min // 2


def match_key(fields: Sequence[str], present: Sequence[str]) -> Column:
    """Digest of source, title and the present match fields (names included)."""
    parts = [F.col("source"), F.col("title")]
    parts += [F.col(f) if f in present else F.lit(None).cast("string").alias(f) for f in fields]
    return F.md5(F.to_json(F.struct(*parts)))


def _own_key(fields: Sequence[str]) -> Column:
    return F.md5(F.to_json(F.struct("source", "title", *fields)))


def _projected_keys(fields: Sequence[str], sizes: Sequence[int]) -> Column:
    """Keys under which a kept row can be found by alerts having fewer fields."""
    keys = []
    for size in sizes:
        for subset in combinations(fields, size):
            usable = F.lit(True)
            for f in subset:
                usable = usable & F.col(f).isNotNull()
            keys.append(F.when(usable, match_key(fields, subset)))
    return F.array_compact(F.array(*keys))


def _chain_walker(window_us: int, columns: Sequence[str]):
    """Keeps a row when it is later than the last kept row of its run plus the window."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, last = None, _NEVER
        for pdf in batches:
            if pdf.empty:
                continue
            t = pdf["t"].to_numpy()
            runs = list(zip(pdf["gkey"], pdf["span"]))
            change = (pdf["gkey"].ne(pdf["gkey"].shift()) | pdf["span"].ne(pdf["span"].shift())).to_numpy()
            starts = np.flatnonzero(change)
            kept: list[int] = []
            for lo, hi in zip(starts, [*starts[1:], len(t)]):
                if runs[lo] != run:
                    carried = pdf["carry"].iat[lo]
                    run, last = runs[lo], (_NEVER if pd.isna(carried) else int(carried))
                part = t[lo:hi]
                at = int(np.searchsorted(part, last + window_us, side="right"))
                while at < len(part):
                    kept.append(lo + at)
                    last = int(part[at])
                    at = int(np.searchsorted(part, last + window_us, side="right"))
            yield pdf.iloc[kept][list(columns)]

    return walk


def _span_function(window_us: int):
    """Per (key, span): the last kept time for every first kept time that can occur. Rows come sorted by key, span and time."""

    def function_of(key: str, span: int, t: np.ndarray) -> pd.DataFrame:
        follow = np.searchsorted(t, t + window_us, side="right")
        end = np.where(follow < len(t), follow, np.arange(len(t)))
        while True:
            further = end[end]
            if (further == end).all():
                break
            end = further
        entries = min(int(np.searchsorted(t, span + window_us)) + 1, len(t))
        leave = t[end[:entries]]
        last_of_run = np.append(leave[1:] != leave[:-1], True)
        return pd.DataFrame({"gkey": key, "span": span, "enter": t[:entries][last_of_run], "leave": leave[last_of_run]})

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun, times = None, []  # the span that the next batch may continue
        for pdf in batches:
            if pdf.empty:
                continue
            keys, spans, t = pdf["gkey"].to_numpy(), pdf["span"].to_numpy(), pdf["t"].to_numpy()
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (spans[1:] != spans[:-1])))
            out = []
            for lo, hi in zip(starts, [*starts[1:], len(t)]):
                own = (keys[lo], int(spans[lo]))
                if own != begun:
                    if begun is not None:
                        out.append(function_of(*begun, np.concatenate(times)))
                    begun, times = own, []
                times.append(t[lo:hi])
            if out:
                yield pd.concat(out, ignore_index=True)
        if begun is not None:
            yield function_of(*begun, np.concatenate(times))

    return build


def _span_folder(window_us: int):
    """Follows one key through its spans, in order, holding only the last kept time."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, span, last, settled = None, None, _NEVER, False
        for pdf in batches:
            out = []
            for (k, s), part in pdf.groupby(["gkey", "span"], sort=False):
                if k != key:
                    key, span, last = k, None, _NEVER
                if s != span:
                    span, settled = s, False
                    out.append((k, s, last))
                if not settled:
                    enter = part["enter"].to_numpy()
                    at = int(np.searchsorted(enter, last + window_us, side="right"))
                    if at < len(enter):
                        last, settled = int(part["leave"].iat[at]), True
            yield pd.DataFrame(out, columns=["gkey", "span", "carry"])

    return fold


def keep_chain(rows: DataFrame, window_us: int, *, span_us: int = SPAN_US) -> DataFrame:
    """Rows kept by the plain chain of each ``gkey``; ``rows`` has ``gkey, t, id`` and more.

    Every key is cut into time spans, which are worked out apart, followed through in order and then walked apart.
    """
    payload = [f for f in rows.schema.fields if f.name != "gkey"]
    marked = cut_lineage(rows.withColumn("span", (F.col("t") - F.pmod("t", F.lit(span_us))).cast("bigint")))
    pieces = (
        marked.select("gkey", "span", "t")
        .repartition("gkey", "span")
        .sortWithinPartitions("gkey", "span", "t")
        .mapInPandas(_span_function(window_us), "gkey string, span bigint, enter bigint, leave bigint")
    )
    carries = (
        pieces.repartition("gkey")
        .sortWithinPartitions("gkey", "span", "enter")
        .mapInPandas(_span_folder(window_us), "gkey string, span bigint, carry bigint")
    )
    return (
        marked.join(carries, ["gkey", "span"], "left")
        .repartition("gkey", "span")
        .sortWithinPartitions("gkey", "span", "t", "id")
        .mapInPandas(_chain_walker(window_us, [f.name for f in payload]), T.StructType(payload))
    )


def suppress_repeats(
    alerts: DataFrame,
    fields_by_source: Mapping[str, Sequence[str]] = FIELDS_BY_SENSOR,
    *,
    window_minutes: int = rules.REPEAT_WINDOW_MINUTES,
    kept_before: DataFrame | None = None,
    span_us: int = SPAN_US,
) -> DataFrame:
    """Id of every alert of the given sources with ``duplicate_of`` (null for kept ones).

    ``created_at`` is the clock and ``id`` breaks ties. A field that a source does not
    compare counts as missing in its alerts. ``kept_before`` holds incidents kept by
    earlier runs, which suppress but are not judged again.
    """
    window_us = window_minutes * MICROS_PER_MINUTE
    fields = sorted({f for names in fields_by_source.values() for f in names})

    def compared(field: str) -> Column:
        sources = [s for s, names in fields_by_source.items() if field in names]
        return F.when(F.col("source").isin(*sources), truthy(F.col(field))).alias(field)

    def shaped(df: DataFrame) -> DataFrame:
        mine = df.filter(F.col("source").isin(*fields_by_source))
        return mine.select("id", "source", "title", micros(F.col("created_at")).alias("t"), *[compared(f) for f in fields])

    present = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    rows = cut_lineage(shaped(alerts).withColumn("gkey", _own_key(fields)).withColumn("level", present))
    levels = sorted((r[0] for r in rows.select("level").distinct().collect()), reverse=True)
    columns = ["id", "source", "title", "t", *fields]

    def findable(kept: DataFrame, sizes: Sequence[int]) -> DataFrame:
        return kept.select(
            F.explode(_projected_keys(fields, sizes)).alias("gkey"), "t", "id", F.struct("id").alias("payload")
        )

    kept = shaped(kept_before).select(*columns) if kept_before is not None else None
    for level in levels:
        open_rows = rows.filter(F.col("level") == level).drop("level")
        if kept is not None:
            judged = last_before(open_rows, findable(kept, [level]), "gkey", window_us)
            open_rows = judged.filter(F.col("found").isNull()).drop("found", "found_t")
        new = cut_lineage(keep_chain(open_rows, window_us, span_us=span_us).select(*columns))
        kept = new if kept is None else kept.unionByName(new)
    if kept is None or not levels:
        return rows.select("id", F.lit(None).cast("bigint").alias("duplicate_of"))
    verdict = last_before(rows.select("gkey", "t", "id"), findable(kept, levels), "gkey", window_us)
    return verdict.select("id", F.col("found.id").alias("duplicate_of"))
