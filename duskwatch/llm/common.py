"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.session import cut_lineage, prepare, run_folder

__all__ = [
    "column", "cut_lineage", "doc_slices", "documents", "equal_keys", "hashed_words", "is_held_out", "join_by_key", "keep_rows", "map_batches",
    "prefix_sums", "prepare", "run_folder", "table", "text_of", "utf8_parts", "with_columns_in_python",
]

SLICE_BYTES = 2_000_000  # text that one vectorised step works on; bounds the worker's memory


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def column(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str = "text") -> Column:
    """A text column, null as empty."""
    return F.coalesce(column(name).cast("string"), F.lit(""))


def is_held_out(doc_id: Column) -> Column:
    """Rows no label may be learnt from: crc32 of the id as text divides by five. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` yields record batches for each record batch of ``df``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return df.mapInArrow(run, schema)


def with_columns_in_python(df: DataFrame, text_col: str, work: Callable[[pa.Array], Sequence[pa.Array]], added: Sequence[tuple[str, str]]) -> DataFrame:
    """``df`` with columns that ``work`` makes from its text (null as empty), other columns unchanged.

    ``work`` gets the texts of at most about ``SLICE_BYTES``, unless a single text is longer.
    An added column replaces one of the same name.
    """
    hidden = f"__text_{uuid.uuid4().hex[:8]}"
    names = [name for name, _ in added]
    kept = [f for f in df.schema.fields if f.name not in names]
    sent = df.select(*[column(f.name) for f in kept], text_of(text_col).alias(hidden))
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept] + [f"{n} {t}" for n, t in added])

    def run(batch):
        for part in utf8_parts(batch, hidden):
            made = work(part.column(part.schema.names.index(hidden)))
            columns = [part.column(i) for i, n in enumerate(part.schema.names) if n != hidden]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=[f.name for f in kept] + names)

    return map_batches(sent, run, schema)


def utf8_parts(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts come to at most about ``SLICE_BYTES``, with a row at least."""
    texts = batch.column(batch.schema.names.index(name))
    start, total = 0, 0
    for i, n in enumerate(np.diff(_offsets(texts)).tolist()):
        if i > start and total + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def doc_slices(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array of texts in one piece, and where each text begins (and the last ends)."""
    offsets = _offsets(texts)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


_BYTE_VALUES = np.random.default_rng(20260102).integers(1, 2**63, 256, dtype=np.uint64)
_PLACES = np.random.default_rng(20260103).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def hashed_words(data: np.ndarray, in_word: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word (run of bytes marked ``in_word`` within one text) begins, and a 64-bit hash of its bytes."""
    first = in_word.copy()
    first[1:] &= ~in_word[:-1]
    heads = starts[:-1][starts[:-1] < len(data)]
    first[heads] = in_word[heads]
    at = np.flatnonzero(first)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    rest = data[at[0] :]
    place = np.arange(len(rest)) - np.repeat(at - at[0], np.diff(np.append(at, len(data))))
    parts = _BYTE_VALUES[rest] * _PLACES[place & 63]
    parts[~in_word[at[0] :]] = 0
    hashes = np.add.reduceat(parts, at - at[0])
    return at, hashes ^ hashes >> np.uint64(29)


def equal_keys(left: Sequence[Column], right: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, [a.eqNullSafe(b) for a, b in zip(left, right, strict=True)])


def keep_rows(docs: DataFrame, stay: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` named by ``stay`` (doc_id, text_sha256, copies: the number of rows alike in both), all columns; of rows alike, one."""
    names = [column(c) for c in docs.columns]
    keys = stay.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), F.col("copies").alias("__copies"))
    marked = docs.select(*names, F.sha2(text_of(text_col), 256).alias("__own"))
    joined = marked.join(keys, equal_keys([column(id_col), F.col("__own")], [F.col("__id"), F.col("__sha")]))
    alone = joined.filter("__copies = 1").select(*names)
    repeated = joined.filter("__copies > 1").groupBy("__id", "__sha").agg(F.first(F.struct(*names)).alias("__row"))
    return alone.unionByName(repeated.select("__row.*"))


def join_by_key(rows: DataFrame, table: DataFrame, key: str, many: str, share: int = 1000) -> DataFrame:
    """``rows`` with the other columns of ``table``, which has one row for each value of ``key`` (null is one too) and ``many``, the number of rows that have it.

    Values that more than one in ``share`` rows have are at most ``share``, so these are broadcast; the rows of the other values are
    shuffled, and none of those has more rows than that. ``rows`` is read twice, so it should be a written table.
    """
    n = rows.count()
    named = table.select(*[column(c).alias("__key" if c == key else c) for c in table.columns if c != many], F.col(many).alias("__many"))
    hot = F.broadcast(named.filter(F.col("__many") > n // share).drop("__many"))
    cold = named.filter(F.col("__many") <= n // share).drop("__many")
    same = column(key).eqNullSafe(F.col("__key"))
    often = rows.join(hot, same).drop("__key")
    rest = rows.join(hot.select("__key"), same, "left_anti")
    return often.unionByName(rest.join(cold, same).drop("__key"))


def prefix_sums(df: DataFrame, order: Sequence[Column], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over all rows up to and including each row in the given order.

    Rows are dealt to ranges of the order, each range is summed, and a range's rows add up from
    where the ranges before it ended. No task sees more than its range; only one sum for each range
    travels. Equal rows of the order must be alike for the result to be the same each time.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut_lineage(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))
    sums = ranged.groupBy("__range").agg(F.sum(value).alias("__sum"))  # one row for each range
    before = sums.select("__range", F.coalesce(F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.withColumn("__inside", F.sum(value).over(inside))
    return running.join(before, "__range").withColumn(out, F.col("__before") + F.col("__inside")).drop("__range", "__before", "__inside")
