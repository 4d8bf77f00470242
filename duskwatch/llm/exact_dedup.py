"""Exact duplicates by content-defined chunk recipes.

Every text is cut where its own bytes say so (a rolling hash over the last 32 bytes), so equal
texts are cut alike. The chunks of all texts are deduplicated by their bytes; each distinct chunk
has an identifier, its 64-bit hash, and an ordinal where chunks of one hash differ, so that two
chunks have one identifier only if their bytes have been compared. A text's recipe is the ordered list of its chunks'
identifiers: eight bytes for about a kilobyte of text. Equal recipes mean equal texts, and only recipes are grouped and joined.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.llm.common import column, cut_lineage, doc_slices, keep_rows, map_batches, text_of, utf8_parts

WINDOW = 32  # bytes the rolling hash sees
MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 512, 1024, 8192  # MEAN_CHUNK: mean distance of cut points beyond the minimum, a power of two
HASH_BITS = 64
_GEAR = np.random.default_rng(20260101).integers(0, 2**32, 256, dtype=np.uint32)


def cut_texts(data: np.ndarray, starts: np.ndarray, *, least: int = MIN_CHUNK, mean: int = MEAN_CHUNK, most: int = MAX_CHUNK) -> list[list[int]]:
    """For each text its chunks' ends, as positions in ``data``. No chunk is longer than ``most``; only a last one is shorter than ``least``."""
    h = _GEAR[data]
    for shift in (1, 2, 4, 8, 16):  # h[i] = sum over j < 32 of gear[data[i - j]] << j
        longer = h.copy()
        longer[shift:] += h[:-shift] << np.uint32(shift)
        h = longer
    marks = (np.flatnonzero(h >> np.uint32(32 - int(mean).bit_length() + 1) == 0) + 1).tolist()
    ends, m = [], 0
    for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        own, last = [], begin
        while m < len(marks) and marks[m] < begin + WINDOW:  # the window would reach into the text before
            m += 1
        while m < len(marks) and marks[m] < end:
            cut = marks[m]
            m += 1
            while cut - last > most:
                last += most
                own.append(last)
            if cut - last >= least:
                last = cut
                own.append(last)
        while end - last > most:
            last += most
            own.append(last)
        if end > last:
            own.append(end)
        ends.append(own)
    return ends


def _signed(hashes: list[int], bits: int) -> list[int]:
    mask = (1 << bits) - 1
    return [(x & mask) - (1 << 64) if x & mask >= 1 << 63 else x & mask for x in hashes]


def recipes(df: DataFrame, id_col: str, text_col: str, bits: int = HASH_BITS) -> DataFrame:
    """(id, text_sha256, hashes): each text's digest and the hashes of its chunks in order."""
    kind = df.schema[id_col].dataType.simpleString()

    def work(batch):
        for part in utf8_parts(batch, "text"):
            data, starts = doc_slices(part.column(1))
            whole = data.tobytes()
            shas, lists = [], []
            for i, ends in enumerate(cut_texts(data, starts)):
                shas.append(hashlib.sha256(whole[starts[i] : starts[i + 1]]).hexdigest())
                begins = [int(starts[i]), *ends[:-1]]
                lists.append(_signed([xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip(begins, ends, strict=False)], bits))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shas, pa.string()), pa.array(lists, pa.list_(pa.int64()))], names=["id", "text_sha256", "hashes"])

    return map_batches(df.select(column(id_col).alias("id"), text_of(text_col).alias("text")), work, f"id {kind}, text_sha256 string, hashes array<bigint>")


def chunks(df: DataFrame, text_col: str, bits: int = HASH_BITS) -> DataFrame:
    """(hash, content) of the chunks of all texts, once for each batch that holds them."""

    def work(batch):
        for part in utf8_parts(batch, "text"):
            data, starts = doc_slices(part.column(0))
            whole, found = data.tobytes(), set()
            for begin, ends in zip(starts.tolist(), cut_texts(data, starts), strict=False):
                for end in ends:
                    found.add(whole[begin:end])
                    begin = end
            contents = list(found)
            yield pa.RecordBatch.from_arrays([pa.array(_signed([xxhash.xxh3_64_intdigest(c) for c in contents], bits), pa.int64()), pa.array(contents, pa.binary())], names=["hash", "content"])

    return map_batches(df.select(text_of(text_col).alias("text")), work, "hash bigint, content binary")


def clashing_chunks(df: DataFrame, text_col: str, bits: int = HASH_BITS) -> DataFrame:
    """(hash, content, ordinal) of the distinct chunks that share a hash with another one; with 64 bits there is hardly ever one.

    Contents are compared by grouping on them, so each distinct chunk moves once (once from each task that read it).
    """
    distinct = chunks(df, text_col, bits).groupBy("hash", "content").agg(F.count(F.lit(1)).alias("n"))
    first = cut_lineage(distinct.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"))
    if first.isEmpty():
        return first.select("hash", F.lit(b"").alias("content"), F.lit(0).cast("long").alias("ordinal"))
    of_hash = Window.partitionBy("hash").orderBy("content")  # distinct contents of one hash: a handful
    return cut_lineage(distinct.join(first, "hash", "left_semi").select("hash", "content", F.row_number().over(of_hash).cast("long").alias("ordinal")))


def identified_recipes(df: DataFrame, id_col: str, text_col: str, bits: int = HASH_BITS) -> DataFrame:
    """(id, text_sha256, recipe): recipe lists verified chunk identifiers (hash, and ordinal among chunks of that hash; 0 if it is alone)."""
    plain = recipes(df, id_col, text_col, bits)
    clashes = clashing_chunks(df, text_col, bits)
    if clashes.isEmpty():
        return plain.select("id", "text_sha256", F.transform("hashes", lambda h: F.struct(h.alias("hash"), F.lit(0).cast("long").alias("ordinal"))).alias("recipe"))
    # Rare: texts that hold such chunks get their ordinals from the contents.

    def work(batch):
        for part in utf8_parts(batch, "text"):
            data, starts = doc_slices(part.column(0))
            whole = data.tobytes()
            rows: dict = {"sha": [], "pos": [], "hash": [], "content": []}
            for i, ends in enumerate(cut_texts(data, starts)):
                sha, begin = hashlib.sha256(whole[starts[i] : starts[i + 1]]).hexdigest(), int(starts[i])
                for pos, end in enumerate(ends):
                    rows["sha"].append(sha)
                    rows["pos"].append(pos)
                    rows["content"].append(whole[begin:end])
                    begin = end
            rows["hash"] = _signed([xxhash.xxh3_64_intdigest(c) for c in rows["content"]], bits)
            yield pa.RecordBatch.from_arrays([pa.array(rows["sha"], pa.string()), pa.array(rows["pos"], pa.int64()), pa.array(rows["hash"], pa.int64()), pa.array(rows["content"], pa.binary())], names=list(rows))

    found = map_batches(df.select(text_of(text_col).alias("text")), work, "sha string, pos bigint, hash bigint, content binary")
    ordinals = found.join(clashes, ["hash", "content"]).groupBy("sha", "pos").agg(F.max("ordinal").alias("ordinal"))
    lists = ordinals.groupBy("sha").agg(F.map_from_entries(F.collect_list(F.struct("pos", "ordinal"))).alias("ordinals"))
    joined = plain.join(lists, plain["text_sha256"] == lists["sha"], "left")
    ordinal = lambda i: F.coalesce(F.try_element_at("ordinals", i.cast("long")), F.lit(0).cast("long"))
    return joined.select("id", "text_sha256", F.transform("hashes", lambda h, i: F.struct(h.alias("hash"), ordinal(i).alias("ordinal"))).alias("recipe"))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = HASH_BITS) -> DataFrame:
    """One row for each row of ``df``: doc_id, keep_id, group_size, kept, text_sha256, and copies, the number of its rows with this id and text.

    Of equal texts the row with the largest id stays. Null text counts as empty; a null id counts as smaller
    than any other. Rows alike in id and text are all marked kept (``copies`` tells); ``drop_exact_duplicates`` leaves one of them.
    An empty table gives an empty result; other columns of ``df`` play no part. ``bits`` shortens the chunks' hashes, for tests of clashes.
    """
    rows = cut_lineage(identified_recipes(df, id_col, text_col, bits))
    # Counts per recipe and id first, so a text held by a third of all rows comes down to a few sums before it is joined.
    by_id = rows.groupBy("recipe", "id").agg(F.count(F.lit(1)).alias("copies"))
    groups = by_id.groupBy("recipe").agg(F.sum("copies").alias("group_size"), F.max("id").alias("keep_id"), F.max_by("copies", "id").alias("top"), F.sum(F.when(F.col("id").isNull(), F.col("copies"))).alias("nulls"))
    groups = groups.withColumn("copies", F.when(F.col("keep_id").isNull(), F.col("nulls")).otherwise(F.col("top"))).withColumnRenamed("recipe", "of")
    joined = rows.join(groups, rows["recipe"] == groups["of"])
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    return joined.select(F.col("id").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"), "text_sha256", F.when(kept, F.col("copies")).alias("copies"))


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, all columns: of equal texts the one with the largest id (of rows alike in both, one)."""
    stay = cut_lineage(exact_duplicates(df, id_col, text_col).filter("kept").select("doc_id", "text_sha256", "copies").distinct())
    return keep_rows(df, stay, id_col, text_col)
