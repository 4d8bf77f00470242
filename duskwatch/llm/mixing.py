"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled queue, twice over. A copy's virtual time is the words that its source
has served by then, divided by the source's target: all sources reach the end of their targets at time 1.
Copies of all sources are sorted by virtual time in ranges, and those are taken that fit into the total budget.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.llm.common import column, cut_lineage, doc_slices, equal_keys, map_batches, prefix_sums, text_of, utf8_parts

WEIGHTS = (5, 2, 1)  # of the sources in their order, repeating
BUDGET = 1.5  # words taken, as a share of all words
REPEATS = 2  # times that a document is taken at most
SEED = "mix-1"


def word_counts(texts: pa.Array) -> np.ndarray:
    """Words of each text, counted where a byte that is no blank follows a blank or the text's start."""
    data, starts = doc_slices(texts)
    begins = np.zeros(len(data) + 1, np.int64)
    blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    first = np.ones(len(data), bool)
    first[1:] = blank[:-1]
    first[starts[:-1][starts[:-1] < len(data)]] = True
    np.cumsum(first & ~blank, out=begins[1:])
    return begins[starts[1:]] - begins[starts[:-1]]


def sized(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, source, size) for each row, size in words; also text_sha256 if asked for. Null text has none."""
    kinds = [df.schema[c].dataType.simpleString() for c in (id_col, source_col)]

    def work(batch):
        for part in utf8_parts(batch, "text"):
            sizes = pa.array(word_counts(part.column(2)), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), sizes], names=["doc_id", "source", "size"])

    def work_with_digest(batch):
        for part, made in ((p, m) for p in utf8_parts(batch, "text") for m in work(p)):
            shas = [hashlib.sha256(t.as_buffer() or b"").hexdigest() for t in part.column(2)]
            yield pa.RecordBatch.from_arrays([*made.columns, pa.array(shas, pa.string())], names=[*made.schema.names, "text_sha256"])

    rows = df.select(column(id_col).alias("doc_id"), column(source_col).alias("source"), text_of(text_col).alias("text"))
    return map_batches(rows, work_with_digest if digest else work, f"doc_id {kinds[0]}, source {kinds[1]}, size bigint" + ", text_sha256 string" * digest)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, weight, target), one row for each source, from rows (source, size).

    The budget is shared by weight; what exceeds ``repeats`` times a source's size is shared again among the others until
    none is above. That ends at one level: sources whose ``repeats x size / weight`` is below it are full, the others get
    level x weight. Sources are in order of code points, null last. Works on the table of sources alone, which has one row for each.
    """
    totals = cut_lineage(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    given = totals.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int")).cast("bigint"))
    room = F.col("source_size") * repeats
    by_room = Window.orderBy(room / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    level = given.withColumn("share", F.sum("source_size").over(everything) * F.lit(float(budget)))
    level = level.withColumn("left", F.col("share") - F.coalesce(F.sum(room).over(before), F.lit(0))).withColumn("waiting", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # The level if this source and all with more room share what is left; the first that it does not fill sets it, later ones would give less.
    level = level.withColumn("own", F.when(F.col("left") / F.col("waiting") * F.col("weight") <= room, F.col("left") / F.col("waiting")))
    level = level.withColumn("level", F.max("own").over(everything))
    target = F.least(room.cast("double"), F.coalesce(F.col("level") * F.col("weight"), room.cast("double")))
    return level.select("source", "source_size", "weight", target.alias("target"))


def queue_order(id_column: Column) -> Column:
    """A document's place in its source's shuffled queue."""
    return F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(id_column.cast("string"), F.lit(""))))


def mix(rows: DataFrame, *, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """``rows`` (doc_id, source, size and maybe more) with source_size, target, taken, copies.

    ``taken`` is the size times ``copies``, the times that the document is in the mix, 0 to ``repeats``; documents are
    taken whole. A null source is a source of its own; a null size counts as 0; rows without words take nothing; no rows give no rows.
    The shuffled place depends on the id alone, ties go by the other columns, so reruns agree.
    """
    more = [c for c in rows.columns if c not in ("doc_id", "source", "size")]
    base = cut_lineage(rows.select("doc_id", "source", F.coalesce(column("size").cast("bigint"), F.lit(0)).alias("size"), *[column(c) for c in more], queue_order(column("doc_id")).alias("__place")))
    targets = cut_lineage(source_targets(base, weights, budget, repeats))
    by_source = F.col("source").asc_nulls_last()
    order = [by_source, F.col("__place"), F.col("doc_id").asc_nulls_first(), F.col("size"), *[column(c).asc_nulls_first() for c in more]]
    summed = prefix_sums(base, order, "size", "__sum")  # differs for each row that has words, so it names the row from here on
    # Where each source begins in the order of all rows; one row for each source.
    earlier = Window.orderBy(by_source).rowsBetween(Window.unboundedPreceding, -1)
    begins = targets.select(F.col("source").alias("__source"), "source_size", "target", F.coalesce(F.sum("source_size").over(earlier), F.lit(0)).alias("__begin"))
    queued = cut_lineage(summed.join(begins, F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "__place"))
    # The time at which a copy's middle word is served, so that rounding to whole documents errs to either side alike.
    served = F.col("__sum") - F.col("__begin") - F.col("size") / 2.0
    times = [((served + F.col("source_size") * i) / F.col("target")).alias(f"__t{i}") for i in range(repeats)]
    takes_part = queued.filter("size > 0 and target > 0")
    copies = takes_part.select("size", F.explode(F.array(*[F.struct(t.alias("time"), F.col("__sum").alias("sum")) for t in times])).alias("__turn"))
    running = prefix_sums(copies.select("size", "__turn"), [F.col("__turn")], "size", "__running")
    allowed = float(targets.agg(F.sum("source_size")).first()[0] or 0) * float(budget)
    last = running.filter(F.col("__running") - F.col("size") / 2.0 <= F.lit(allowed)).agg(F.max("__turn").alias("turn")).first()["turn"]
    if last is None:
        got = F.lit(0).cast("bigint")
    else:
        at, row = F.lit(float(last["time"])), F.lit(int(last["sum"]))
        inside = [((t < at) | ((t == at) & (F.col("__sum") <= row))).cast("bigint") for t in times]
        got = F.when((F.col("size") > 0) & (F.col("target") > 0), reduce(lambda a, b: a + b, inside)).otherwise(F.lit(0)).cast("bigint")
    return queued.select("doc_id", "source", "size", *[column(c) for c in more], "source_size", "target", (got * F.col("size")).alias("taken"), got.alias("copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the mix takes, all columns, each as many times as it is taken."""
    rows = sized(docs, id_col, source_col, text_col, digest=True)
    taken = mix(rows).filter("copies > 0")
    key = ["doc_id", "source", "text_sha256"]
    per = taken.groupBy(*key).agg(F.sum("copies").alias("__copies"))
    alike = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__rows"))
    per = cut_lineage(per.alias("a").join(alike.alias("b"), equal_keys([F.col(f"a.{k}") for k in key], [F.col(f"b.{k}") for k in key])).select(*[F.col(f"a.{k}").alias(f"__{k}") for k in key], "__copies", "__rows"))
    names = [column(c) for c in docs.columns]
    marked = docs.select(*names, F.sha2(text_of(text_col), 256).alias("__own"))
    joined = marked.join(per, equal_keys([column(id_col), column(source_col), F.col("__own")], [F.col(f"__{k}") for k in key]))
    alone = joined.filter("__rows = 1").withColumn("__mine", F.col("__copies"))
    # Rows alike in all three share their copies out among themselves.
    nth = F.row_number().over(Window.partitionBy("__doc_id", "__source", "__own").orderBy(F.lit(0)))
    shared = F.floor(F.col("__copies") / F.col("__rows")) + (nth <= F.col("__copies") % F.col("__rows")).cast("bigint")
    repeated = joined.filter("__rows > 1").withColumn("__mine", shared.cast("bigint"))
    both = alone.unionByName(repeated).filter("__mine > 0")
    return both.withColumn("__turn", F.explode(F.sequence(F.lit(1), F.col("__mine").cast("int")))).select(*names)


def mixing_sql(weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> str:
    """The same for DuckDB over ``documents``."""
    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {weight} END AS BIGINT) AS weight, {repeats} * source_size AS room,
  CAST(sum(source_size) OVER () AS DOUBLE) * {budget} AS share FROM t),
l AS (SELECT *, share - coalesce(sum(room) OVER (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS waiting FROM w),
v AS (SELECT *, max(CASE WHEN rest / waiting * weight <= room THEN rest / waiting END) OVER () AS level FROM l),
g AS (SELECT source, source_size, least(CAST(room AS DOUBLE), coalesce(level * weight, CAST(room AS DOUBLE))) AS target, share FROM v),
q AS (SELECT d.doc_id, d.source, d.size, d.place, g.source_size, g.target, g.share,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) AS served,
  sum(d.size) OVER (ORDER BY d.source NULLS LAST, d.place, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) AS named
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT q.*, k.copy, (served - size / 2.0 + source_size * k.copy) / target AS turn FROM q, (SELECT unnest(range({repeats})) AS copy) k WHERE size > 0 AND target > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY turn, named ROWS UNBOUNDED PRECEDING) AS running FROM c),
n AS (SELECT named, count(*) AS copies FROM r WHERE running - size / 2.0 <= share GROUP BY named)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(CASE WHEN q.size > 0 THEN coalesce(n.copies, 0) * q.size ELSE 0 END AS BIGINT) AS taken
FROM q LEFT JOIN n ON q.named = n.named"""
