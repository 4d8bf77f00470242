"""Bounded samples of labelled documents to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import column, cut_lineage, is_held_out

LONGEST = 65_536  # bytes of a text to learn from; longer ones are scored whole like all others, but not learnt from


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(text, label) of at most ``per_class`` rows of each of the labels 0 and 1, and how many rows each label has.

    Rows whose crc32(id) divides by five are never among them, nor null ids, null labels and null texts. Of all others
    those with the lowest hashes of their id and text are taken, so that the sample doesn't depend on how rows are dealt.
    No text is shortened; those of over ``LONGEST`` bytes are not drawn, so the sample's size has a bound.
    """
    own = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text")).filter(F.col("id").isNotNull() & (F.octet_length("text") <= LONGEST) & ~is_held_out(F.col("id")))
    marks = labels.select(F.col("doc_id").alias("of"), column(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("of").isNotNull() & ~is_held_out(F.col("of")))
    # An id with two labels teaches neither.
    marks = cut_lineage(marks.groupBy("of").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").select("of", "label"))
    counts = {int(r["label"]): int(r["n"]) for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = None
    for value in (0, 1):
        some = marks.filter(F.col("label") == value).select("of", "label", F.xxhash64("of").alias("h")).orderBy("h", "of").limit(per_class)
        drawn = some if drawn is None else drawn.unionByName(some)
    chosen = cut_lineage(drawn.select("of", "label"))  # at most twice per_class ids
    joined = own.join(F.broadcast(chosen), F.col("id") == F.col("of"))
    # Ids may be repeated in documents, so the bound is set once more on what was found.
    return joined.select("text", "label", F.xxhash64("id", "text").alias("h")).orderBy("h").limit(2 * per_class).select("text", "label"), counts
