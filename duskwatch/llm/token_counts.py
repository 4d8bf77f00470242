"""Token counts that follow edits.

A document's pre-tokens are kept as the leaves of a tree: blocks of pre-tokens with their lengths and token counts, and
above them the sums of characters and tokens of each subtree. An edit re-encodes from the pre-token
before the touched place (and before white space or an apostrophe in front of it) to the first old boundary that the new pre-tokens meet again,
and only the sums above the touched blocks change.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.bpe import CACHED_PIECES, PUBLIC_PATTERN, Codec, codec_of, read_ranks
from duskwatch.llm.common import column, map_batches, text_of, utf8_parts

BLOCK = 64  # pre-tokens of a leaf, as built
AHEAD = 256  # characters that are read on at a time until boundaries meet


class CountTree:
    """Characters and tokens of a text by blocks of pre-tokens."""

    def __init__(self, codec: Codec, text: str):
        self.codec, self.text, self.encoded = codec, text, 0
        pieces = codec.pieces(text)
        lengths, counts = list(map(len, pieces)), self._counts(pieces)
        self.encoded = 0  # what building took doesn't count
        self.lengths = [lengths[i : i + BLOCK] for i in range(0, len(lengths), BLOCK)] or [[]]
        self.counts = [counts[i : i + BLOCK] for i in range(0, len(counts), BLOCK)] or [[]]
        self.size = 1 << (len(self.lengths) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i in range(len(self.lengths)):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(self.lengths[i]), sum(self.counts[i])
        for i in range(self.size - 1, 0, -1):
            self._add_up(i)

    def _counts(self, pieces: list[str]) -> list[int]:
        self.encoded += len(pieces)
        packed = self.codec.packed
        return [len(packed[p]) // 4 for p in pieces]

    def _add_up(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _find(self, at: int) -> tuple[int, int]:
        """The block that holds the character ``at``, and where the block starts. Beyond the text: its last block."""
        node, start = 1, 0
        at = min(at, self.chars[1] - 1)
        while node < self.size:
            node *= 2
            if at >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def edit(self, at: int, delete: int, insert: str) -> None:
        """Replace ``delete`` characters at ``at`` by ``insert``; both ends are moved into the text if they lie outside."""
        old = self.text
        at = max(0, min(at, len(old)))
        end = max(at, min(at + delete, len(old)))
        new = old[:at] + insert + old[end:]
        if not old:
            self.__init__(self.codec, new)
            self.encoded = sum(map(len, self.lengths))
            return
        back = at
        while back and old[back - 1].isspace():
            back -= 1
        back = max(0, back - 2)  # an apostrophe's match depends on two characters after it
        first, start = self._find(max(0, back - 1))
        here, kept = start, 0  # the pre-token that holds back - 1 starts at here
        for n in self.lengths[first]:
            if here + n > max(0, back - 1):
                break
            here += n
            kept += 1
        # Old boundaries from the end of the edit on, as positions in the new text, block by block as needed.
        shift = len(insert) - (end - at)
        last, last_start = self._find(end) if end < len(old) else (len(self.lengths) - 1, None)
        if last_start is None:
            last_start = len(old) - sum(self.lengths[last])
        block, place, position = last, 0, last_start
        lengths, counts, where, reach = [], [], here, at + len(insert)
        met = None
        while met is None:
            reach += AHEAD
            ahead = new[where:reach]
            pieces = self.codec.pieces(ahead)
            if reach < len(new):
                del pieces[-2:]  # might go on
                if not pieces:
                    reach += 2 * (reach - where)  # one long pre-token
                    continue
            for i, piece in enumerate(pieces):
                while position + shift < where and block < len(self.lengths):
                    if place < len(self.lengths[block]):
                        position += self.lengths[block][place]
                        place += 1
                    else:
                        block, place = block + 1, 0
                if where >= at + len(insert) and position + shift == where and position >= end:
                    met, pieces = (block, place), pieces[:i]
                    break
                where += len(piece)
            lengths += map(len, pieces)
            counts += self._counts(pieces)
            if met is None and where >= len(new):
                met = (len(self.lengths), 0)
        self.text = new
        block, place = met
        if block < len(self.lengths) and place == len(self.lengths[block]):
            block, place = block + 1, 0
        head_l, head_c = self.lengths[first][:kept], self.counts[first][:kept]
        if block == first:
            head_tail_l, head_tail_c = self.lengths[first][place:], self.counts[first][place:]
        else:
            head_tail_l, head_tail_c = [], []
        touched = {first}
        for i in range(first + 1, min(block + 1, len(self.lengths))):
            cut = place if i == block else len(self.lengths[i])
            if cut:
                self.lengths[i], self.counts[i] = self.lengths[i][cut:], self.counts[i][cut:]
                touched.add(i)
        self.lengths[first], self.counts[first] = head_l + lengths + head_tail_l, head_c + counts + head_tail_c
        for i in touched:
            self.chars[self.size + i], self.tokens[self.size + i] = sum(self.lengths[i]), sum(self.counts[i])
        nodes = {(self.size + i) // 2 for i in touched}
        while nodes and max(nodes):
            for i in nodes:
                self._add_up(i)
            nodes = {i // 2 for i in nodes if i > 1}


def count_with_edits(df: DataFrame, ranks_path: str, edits: str = "edits", pattern: str = PUBLIC_PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: doc_id, n_tokens, n_tokens_edited, n_chars_edited, n_pieces (as first built), n_reencoded (pre-tokens that the edits re-encoded).

    ``edits`` is a column of array<struct<at, delete, insert>>, applied in order, each on the result of the one before; positions
    count code points and are moved into the text. Null text counts as empty; a null list, null edit or null number or text in
    one changes nothing. Ids may be null or repeated; each row is counted for itself. Other columns play no part.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(read_ranks(spark, ranks_path))
    kind = df.schema[id_col].dataType.simpleString()

    def work(batch):
        codec = codec_of(sent.value, pattern)
        for part in utf8_parts(batch, "text"):
            if len(codec.packed) > CACHED_PIECES:
                codec.packed.clear()
            rows = []
            for text, changes in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                tree = CountTree(codec, text)
                before, pieces = tree.total, sum(map(len, tree.lengths))
                for change in changes or ():
                    if change and change["at"] is not None:
                        tree.edit(change["at"], change["delete"] or 0, change["insert"] or "")
                rows.append((before, tree.total, len(tree.text), pieces, tree.encoded))
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n_tokens", "n_tokens_edited", "n_chars_edited", "n_pieces", "n_reencoded"])

    sent_rows = df.select(column(id_col).alias("doc_id"), text_of(text_col).alias("text"), column(edits).cast("array<struct<at:bigint,delete:bigint,insert:string>>").alias("edits"))
    return map_batches(sent_rows, work, f"doc_id {kind}, n_tokens bigint, n_tokens_edited bigint, n_chars_edited bigint, n_pieces bigint, n_reencoded bigint")


def drawn_edits(doc_id: str = "doc_id", text: str = "text", n_edits: int = 4) -> Column:
    """Edits drawn from a document's own id and text: each deletes some characters at a place and puts a piece of the text there."""
    size = F.greatest(F.char_length(text_of(text)), F.lit(1))
    key = F.coalesce(column(doc_id).cast("string"), F.lit(""))
    draw = lambda i, what, most: F.pmod(F.xxhash64(key, F.lit(f"{what}{i}")), most.cast("bigint"))
    edits = [F.struct(draw(i, "at", size).alias("at"), draw(i, "delete", F.lit(12)).alias("delete"), F.substring(text_of(text), draw(i, "from", F.least(size, F.lit(2000))).cast("int") + 1, (draw(i, "take", F.lit(30))).cast("int")).alias("insert")) for i in range(n_edits)]
    return F.array(*edits)
