"""Byte-level BPE encoding and decoding.

A text is split into pre-tokens by a pattern, and each pre-token's bytes are merged by the ranks of a
vocabulary file. Texts that are long are cut into overlapping windows that are pre-tokenised in
parallel; two neighbouring windows are stitched at the first place in their overlap where both have a pre-token
boundary (from there on they agree, as the pattern looks at nothing before a boundary), and the pieces
between stitches are encoded, again in parallel. Windows that never agree are read on as one.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import sys
from collections.abc import Sequence

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duskwatch.llm.common import column, cut_lineage, map_batches, text_of, utf8_parts

WINDOW_CHARS = 65_536
OVERLAP_CHARS = 1_024
CACHED_PIECES = 800_000  # pre-tokens a worker remembers, none of over CACHED_CHARS
CACHED_CHARS = 24
LONG_PIECE = 48  # bytes from which merges are found with a heap

# What the public pattern means for texts that are all ASCII, in a form the faster engine knows.
PUBLIC_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """The rank file's bytes (a megabyte or so), read through Spark if it isn't a file of the driver."""
    try:
        with open(path, "rb") as f:
            return f.read()
    except FileNotFoundError:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])


class Codec:
    """Pre-tokenises, encodes and decodes; one for each worker process."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, ranks.splitlines())}
        self.words = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for word, rank in self.ranks.items():
            self.words[rank] = word
        self.any = regex.compile(pattern)
        self.ascii = re.compile(ASCII_PATTERN, re.ASCII) if pattern == PUBLIC_PATTERN else self.any
        self.packed = _Pieces(self)

    def pieces(self, text: str) -> list[str]:
        """The pattern's matches, which cover all of the text."""
        return (self.ascii if text.isascii() else self.any).findall(text)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the adjacent pair of lowest rank (the leftmost of equals) is merged until none is left."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) >= LONG_PIECE:
            return self._merge_long(piece)
        ranks, none = self.ranks, 1 << 40
        cuts = list(range(len(piece) + 1))
        pair = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pair:
            low = min(pair)
            if low == none:
                break
            i = pair.index(low)
            del cuts[i + 1], pair[i]
            if i < len(pair):
                pair[i] = ranks.get(piece[cuts[i] : cuts[i + 2]], none)
            if i:
                pair[i - 1] = ranks.get(piece[cuts[i - 1] : cuts[i + 1]], none)
        return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _merge_long(self, piece: bytes) -> list[int]:
        ranks, n = self.ranks, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))  # of the part that begins at i; 0 once it is merged into another
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = after[i]
            if not end[i] or j >= n or end[j] != to:
                continue
            end[i], end[j], after[i] = to, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (k := before[i]) >= 0 and (r := ranks.get(piece[k:to])) is not None:
                heapq.heappush(heap, (r, k, to))
        return [ranks[piece[i : end[i]]] for i in range(n) if end[i]]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if len(self.packed) > CACHED_PIECES:
            self.packed.clear()
        return b"".join(map(self.packed.__getitem__, self.pieces(text)))

    def decode(self, ids: bytes) -> bytes:
        numbers = memoryview(ids).cast("I")
        return b"".join(map(self.words.__getitem__, numbers))


class _Pieces(dict):
    """Packed ids by pre-token; what is missing is merged, and kept if it is short."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = b"".join(i.to_bytes(4, "little") for i in self.codec.merge(piece.encode()))
        if len(piece) <= CACHED_CHARS:
            self[piece] = ids
        return ids


_codecs: dict[tuple[int, str], Codec] = {}


def codec_of(ranks: bytes, pattern: str) -> Codec:
    """The worker's codec; its cache lives as long as the worker does."""
    key = (hash(ranks), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def _digests(codec: Codec, ids: bytes) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()


def first_shared(left: Sequence[int] | None, right: Sequence[int] | None) -> int | None:
    other = set(right or ())
    return next((x for x in left or () if x in other), None)


def _windows(codec: Codec, text: str, size: int, overlap: int):
    """(k, start, window, boundaries in its first overlap, boundaries in its last overlap), boundaries as positions in the text.

    A match near a window's end might be another one if the window went on (a contraction cut in two, a run that
    continues), so the last two matches give no boundary, unless the text ends there. Neither does a place after white space,
    for a piece that ended with it would be matched differently with nothing behind it.
    """
    step = size - overlap
    for k, start in enumerate(range(0, max(1, len(text) - overlap), step)):
        window = text[start : start + size]
        found, at = [], start
        for piece in codec.pieces(window):
            found.append(at)
            at += len(piece)
        last = start + size >= len(text)
        if not last:
            del found[-2:]
        found = [b for b in found if b > start and not text[b - 1].isspace()]
        yield k, start, window, [b for b in found if b < start + overlap] if k else [], [b for b in found if b >= start + step] if not last else []


def encode_documents(
    df: DataFrame, ranks_path: str, pattern: str = PUBLIC_PATTERN, id_col: str = "doc_id", text_col: str = "text", *,
    window_chars: int = WINDOW_CHARS, overlap_chars: int = OVERLAP_CHARS, with_ids: bool = False,
) -> DataFrame:
    """One row for each row of ``df``: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids as an array if asked for).

    Null text counts as empty: no tokens, digests of nothing. Ids may be null or repeated, rows may be alike; other
    columns play no part. An empty table gives an empty result. The ids are decoded again for decoded_sha256.
    Rows of long texts are told apart by their place in the input, so that should be read from files.
    """
    if not 0 < 2 * overlap_chars <= window_chars:
        raise ValueError("a window must be at least twice as long as the overlap")
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(read_ranks(spark, ranks_path))
    kind = df.schema[id_col].dataType.simpleString()
    ids_field = ", ids array<int>" if with_ids else ""
    result = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{ids_field}"
    rows = df.select(column(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def result_batch(doc_ids, packed: list[bytes], codec: Codec):
        found = [_digests(codec, p) for p in packed]
        columns = [doc_ids, *(pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string())))]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            ends = [0]
            for p in packed:
                ends.append(ends[-1] + len(p) // 4)
            values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(packed))])
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    def encode_short(batch):
        codec = codec_of(sent.value, pattern)
        for part in utf8_parts(batch, "text"):
            yield result_batch(part.column(0), [codec.encode(t) for t in part.column(1).to_pylist()], codec)

    short = map_batches(rows.filter(F.char_length("text") <= window_chars), encode_short, result)

    def cut(batch):
        codec = codec_of(sent.value, pattern)
        for doc, row, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for k, start, window, left, right in _windows(codec, text, window_chars, overlap_chars):
                yield pa.RecordBatch.from_arrays([pa.array([doc], batch.schema.field(0).type), pa.array([row], pa.int64()), pa.array([k], pa.int32()), pa.array([start], pa.int64()), pa.array([window], pa.string()), pa.array([left], pa.list_(pa.int64())), pa.array([right], pa.list_(pa.int64()))], names=["doc_id", "row", "k", "start", "window", "left", "right"])

    long = rows.filter(F.char_length("text") > window_chars).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    windows = cut_lineage(map_batches(long, cut, f"doc_id {kind}, row bigint, k int, start bigint, window string, left array<bigint>, right array<bigint>"))
    in_doc = Window.partitionBy("row").orderBy("k")
    # A text's windows: some dozens of small rows for each million characters.
    stitches = windows.select("row", "k", "right", F.lead("left").over(in_doc).alias("next"), F.lead("k").over(in_doc).alias("more"))
    stitches = stitches.withColumn("stitch", F.array_min(F.array_intersect("right", "next")))
    pieces = stitches.select(
        F.col("row").alias("of_row"), F.col("k").alias("of_k"), "stitch",
        F.coalesce(F.sum(F.col("stitch").isNotNull().cast("int")).over(in_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("piece"),
    )
    joined = windows.join(pieces, (F.col("row") == F.col("of_row")) & (F.col("k") == F.col("of_k")))
    whole = joined.groupBy("row", "piece").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("k", "start", "window", "stitch"))).alias("parts"))
    ends = stitches.groupBy("row").agg(F.sort_array(F.collect_set("stitch")).alias("stitches")).withColumnRenamed("row", "cut_row")
    whole = whole.join(ends, F.col("row") == F.col("cut_row")).select("doc_id", "row", "piece", "parts", F.get("stitches", F.col("piece") - 1).alias("begin"), F.get("stitches", F.col("piece")).alias("end"))

    def encode_piece(batch):
        codec = codec_of(sent.value, pattern)
        table = batch.select(["parts", "begin", "end"]).to_pylist()
        packed = []
        for piece in table:
            text, at = [], piece["parts"][0]["start"]
            first = at
            for part in piece["parts"]:  # windows that never agreed are read on as one
                text.append(part["window"][at - part["start"] :])
                at = part["start"] + len(part["window"])
            joined_text = "".join(text)
            begin = (piece["begin"] or first) - first
            packed.append(codec.encode(joined_text[begin : None if piece["end"] is None else piece["end"] - first]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(packed, pa.binary())], names=["doc_id", "row", "piece", "packed"])

    encoded = map_batches(whole, encode_piece, f"doc_id {kind}, row bigint, piece bigint, packed binary")
    gathered = encoded.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("piece", "packed"))).alias("pieces")).select("doc_id", F.col("pieces.packed").alias("packed"))

    def finish(batch):
        codec = codec_of(sent.value, pattern)
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            yield result_batch(one.column(0), [b"".join(one.column(1)[0].as_py())], codec)

    return short.unionByName(map_batches(gathered, finish, result))


def decode_ids(df: DataFrame, ranks_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of its id lists (null ids as none)."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(read_ranks(spark, ranks_path))

    @F.pandas_udf("binary")
    def decoded(ids):
        codec = codec_of(sent.value, PUBLIC_PATTERN)
        return ids.map(lambda x: b"".join(codec.words[i] for i in x) if x is not None else b"")

    return df.withColumn(out, decoded(column(ids_col)))


assert sys.byteorder == "little"  # packed ids are read as native integers
