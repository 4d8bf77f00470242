"""Jaccard join of word-shingle sets by a token-group matrix.

The matrix says which groups of similar sets hold which tokens. A set can only be linked with one in a group if the group's token union holds
enough of its own tokens, so a set opens only the groups whose union does; members of an opened group are compared exactly.

Three steps keep the matrix small, and none of them loses a link. Sets with too many tokens that no other set has are linked with nothing; counting a fixed
part of all tokens (by hash, the same for every set) proves that for most. The others are grouped by their least token under a random
order, large groups are cut into blocks, and links inside blocks join most near copies into components. What remains is links between components: sets too
many of whose tokens stay in their own component are done. Of the rest, sets that no other component has a partner for, by size and tokens, are left out in rounds, and only what then
is left goes through the matrix.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import SLICE_BYTES, column, cut_lineage, doc_slices, hashed_words, join_by_key, map_batches, text_of, utf8_parts
from duskwatch.llm.components import components

SHINGLE = 5
PERCENT = 80
SHARE = 0.4  # of all tokens, by hash, that are counted to find sets which share too little
TOKENS_AT_ONCE = 1_500_000  # tokens of sets that a task sorts together
BLOCK_SETS, BLOCK_TOKENS = 512, 500_000  # of a group of similar sets, compared in one piece; bounds the worker's memory
GROUP_SETS = 64  # of the matrix
SIZE_STEP = 1.1  # between the classes of sizes by which a token's sets are told apart
ROUNDS = 8  # at most, in which sets without partners are left out; more would only leave out more
QUERIES_AT_ONCE = 2_048  # sets that one task holds against a group
FILTER_BITS = 1 << 26  # at most, of the bitmap that spares sets which were ruled out from being moved: 8 MB
SHORT_WORD = 64  # bytes of a word that are told apart by their places; longer words are hashed by XXH64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_rng = np.random.default_rng(20260311)
_PLACES = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_SEEDS = _rng.integers(1, 2**63, 2, dtype=np.uint64)


def needed(n, percent: int = PERCENT):
    """How many of its ``n`` tokens a set shares at least with any set it is linked with."""
    return -(-n * percent // 100)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ x >> np.uint64(33)


def _long_word(word: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(word.tobytes(), 11)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of texts in lower case begins, and a 64-bit hash of it. White space is 20 and 09 to 0D.

    A text of over ``SLICE_BYTES`` is cut at white space, so memory does not grow with it; a longer word than that is hashed by itself.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    pos, alone = 0, len(starts) == 2
    while pos < len(data):
        end = min(pos + max(SLICE_BYTES, SHORT_WORD + 1), len(data)) if alone else len(data)  # without a blank it is part of a long word
        piece = data[pos:end]
        in_word = ~_BLANK[piece]
        if end < len(data):
            blanks = np.flatnonzero(~in_word)
            if not len(blanks):
                while end < len(data) and not _BLANK[data[end]]:
                    ahead = np.flatnonzero(_BLANK[data[end : end + SLICE_BYTES]])
                    end = end + int(ahead[0]) if len(ahead) else min(end + SLICE_BYTES, len(data))
                found.append((np.array([pos]), mixed(np.array([_long_word(data[pos:end])], np.uint64))))
                pos = end
                continue
            piece, in_word = piece[: blanks[-1] + 1], in_word[: blanks[-1] + 1]
        at, hashes = hashed_words(piece, in_word, np.array([0, len(piece)]) if alone else starts)
        if len(at):
            sizes = np.add.reduceat(in_word[at[0] :].view(np.uint8), at - at[0], dtype=np.int64)
            for i in np.flatnonzero(sizes > SHORT_WORD).tolist():
                hashes[i] = _long_word(piece[at[i] : at[i] + sizes[i]])
        found.append((at + pos, mixed(hashes)))
        pos += len(piece)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def shingle_sets(data: np.ndarray, starts: np.ndarray, shingle: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles of words, A-Z in lower case; with fewer words, of all of them as one; without words, none."""

    def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
        n = max(0, len(hashes) - width + 1)
        total = np.full(n, width, np.uint64)
        for i in range(width):
            total += hashes[i : i + n] * _PLACES[i % 64]
        return mixed(total)

    at, hashes = word_hashes(_FOLD[data], starts)
    bounds = np.searchsorted(at, starts).tolist()
    whole = rolled(hashes, shingle)
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        tokens = np.sort(whole[a : b - shingle + 1]) if b - a >= shingle else rolled(hashes[a:b], b - a) if b > a else whole[:0]
        if len(tokens) > 1:
            fresh = np.ones(len(tokens), bool)
            np.not_equal(tokens[1:], tokens[:-1], out=fresh[1:])
            tokens = tokens[fresh]
        out.append(tokens)
    return out


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """``shingle_sets`` of one text."""
    return shingle_sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]), shingle)[0]


def _sets(batch: pa.RecordBatch, at: int, shingle: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of a batch with the sets of their texts."""
    for part in utf8_parts(batch, batch.schema.names[at]):
        yield part, shingle_sets(*doc_slices(part.column(at)), shingle)


def _mark(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _short(mark: bytes) -> int:
    return int.from_bytes(mark[:8], "little", signed=True)


def marked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, mark, id, n) for each row: a digest of its set and its first half, and the set's size."""
    kind = df.schema[id_col].dataType.simpleString()

    def work(batch):
        for part, sets in _sets(batch, 1, shingle):
            marks = [_mark(s) for s in sets]
            columns = [part.column(0), pa.array([m.hex() for m in marks], pa.string()), pa.array(list(map(_short, marks)), pa.int64()), pa.array(list(map(len, sets)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "id", "n"])

    return map_batches(df.select(column(id_col).alias("doc_id"), text_of(text_col).alias("text")), work, f"doc_id {kind}, mark string, id bigint, n bigint")


# --- sets that share too little ---------------------------------------------
_COUNTED = "key bigint, kind tinyint, class bigint, id bigint"
_TOKEN, _KNOWN, _SET = 0, 1, 2


class _Counting:
    """Rows that tell, over all tasks, which tokens have more than one class.

    Of the sets that a task sees together, tokens of several classes are known to be shared at once: one row says so to the others. Of the
    rest each set gives a row, so a token brings at most one row for each such round and set of its class. A last row for each set says
    how many of its counted tokens were not settled.
    """

    def __init__(self, share: float):
        self.limit = np.uint64(min(int(share * 2.0**64), 2**64 - 1))
        self.held: dict[int, tuple[np.ndarray, int, int]] = {}
        self.tokens = 0

    def add(self, ident: int, group: int, tokens: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(tokens) and ident not in self.held:
            some = tokens[: int(np.searchsorted(tokens, self.limit, "right"))]
            self.held[ident] = (some, group, len(tokens))
            self.tokens += len(some) + 1
            if self.tokens >= TOKENS_AT_ONCE:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        ids = np.fromiter(self.held, np.int64, len(self.held))
        groups = np.array([g for _, g, _ in self.held.values()], np.int64)
        sizes = np.array([n for _, _, n in self.held.values()], np.int64)
        counted = np.array([len(t) for t, _, _ in self.held.values()], np.int64)
        tokens = np.concatenate([t for t, _, _ in self.held.values()])
        self.held, self.tokens = {}, 0
        owner = np.repeat(np.arange(len(ids)), counted)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order].view(np.int64), owner[order]
        known, heads = _several(tokens, groups[owner])
        of_row = np.repeat(known, np.diff(np.append(heads, len(tokens)))) if len(heads) else np.zeros(0, bool)
        open_ = ~of_row
        left = np.bincount(owner[open_], minlength=len(ids))
        markers = tokens[heads[known]] if len(heads) else tokens[:0]
        for key, kind, group, ident in (
            (tokens[open_], _TOKEN, groups[owner[open_]], ids[owner[open_]]),
            (markers, _KNOWN, np.zeros(len(markers), np.int64), np.zeros(len(markers), np.int64)),
            (ids, _SET, sizes << 32 | left, ids),
        ):
            for i in range(0, len(key), 100_000):
                to = i + 100_000
                yield pa.RecordBatch.from_arrays([pa.array(key[i:to]), pa.array(np.full(len(key[i:to]), kind, np.int8)), pa.array(group[i:to]), pa.array(ident[i:to])], names=["key", "kind", "class", "id"])


def _several(keys: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run of equal keys, whether its groups differ; and where runs begin."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, np.int64)
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return np.minimum.reduceat(groups, heads) != np.maximum.reduceat(groups, heads), heads


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From counted rows in the order of keys: (id, shared, sets, n, left), partial sums for each set."""

    def settle(keys, kinds, groups, ids):
        info = kinds == _SET
        packed = groups[info]
        n = int(info.sum())
        yield ids[info], np.zeros(n, np.int64), np.ones(n, np.int64), packed >> 32, packed & 0xFFFFFFFF
        keys, kinds, groups, ids = (x[~info] for x in (keys, kinds, groups, ids))
        if not len(keys):
            return
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        marker = kinds == _KNOWN
        known = np.logical_or.reduceat(marker, heads)
        large, small = np.iinfo(np.int64).max, np.iinfo(np.int64).min
        low, high = np.minimum.reduceat(np.where(marker, large, groups), heads), np.maximum.reduceat(np.where(marker, small, groups), heads)
        several = known | (low < high)
        rows = np.repeat(several, np.diff(np.append(heads, len(keys)))) & ~marker
        found = ids[rows]
        none = np.zeros(len(found), np.int64)
        yield found, none + 1, none, none, none

    held: list[list[np.ndarray]] = []
    rows = 0
    names = ["id", "shared", "sets", "n", "left"]

    def out(parts):
        for found in settle(*parts):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
        rows += batch.num_rows
        if rows >= TOKENS_AT_ONCE:
            parts = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = int(np.searchsorted(parts[0], parts[0][-1], "left"))
            if last:
                yield from out([x[:last] for x in parts])
                parts = [x[last:] for x in parts]
            held, rows = [parts], len(parts[0])
    if held:
        yield from out([np.concatenate(x) for x in zip(*held, strict=True)])


def _survivors(counted: DataFrame, percent: int) -> DataFrame:
    """Ids of the sets that may share enough tokens with sets of another class."""
    n = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = counted.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_shared, "id bigint, shared bigint, sets bigint, n bigint, left bigint")
    sums = found.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("shared", "sets", "left")], F.max("n").alias("n"))
    # Each copy of a set that a task saw counts the same lonely tokens.
    lonely = (F.col("left") - F.col("shared")) / F.col("sets")
    return sums.filter(lonely <= F.col("n") - F.ceil(F.col("n") * percent / 100)).select("id")


def sharing_sets(df: DataFrame, text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, share: float = SHARE) -> DataFrame:
    """(id) of the sets of all texts that may be linked with another: not too many of the counted tokens are in no other set."""

    def work(batches):
        counting = _Counting(share)
        for batch in batches:
            for _, sets in _sets(batch, 0, shingle):
                for tokens in sets:
                    ident = _short(_mark(tokens))
                    yield from counting.add(ident, ident, tokens)
        yield from counting.flush()

    return _survivors(df.select(text_of(text_col).alias("text")).mapInArrow(work, _COUNTED), percent)


def _between(members: DataFrame, percent: int, share: float) -> DataFrame:
    """(id) of the sets that may be linked with a set of another component."""

    def work(batches):
        counting = _Counting(share)
        for batch in batches:
            ids, groups = (batch.column(i).to_pylist() for i in range(2))
            for i, ident in enumerate(ids):
                yield from counting.add(ident, groups[i], _tokens(batch.column(2), i))
        yield from counting.flush()

    return _survivors(members.select("id", F.xxhash64("component").alias("class"), "tokens").mapInArrow(work, _COUNTED), percent)


def _tokens(lists: pa.Array, i: int) -> np.ndarray:
    return lists[i].values.to_numpy(zero_copy_only=False).view(np.uint64)


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bit for the hash of each id, made by tasks; its size is bounded, so beyond it bits are shared and more sets pass than need to."""
    bits = 1 << 16
    count = ids.count()
    while bits < min(16 * count, FILTER_BITS):
        bits *= 2
    bit = F.col("id").bitwiseAND(bits - 1)
    words = ids.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast((id & {bits - 1}) & 63 as int))").alias("b")).groupBy("word").agg(F.bit_or("b").alias("b")).collect()
    out = np.zeros(bits >> 6, np.int64)
    for r in words:
        out[r["word"]] = r["b"]
    return out.view(np.uint64)


def members_of(df: DataFrame, rows: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(mark, id, n, least_0, least_1, tokens), one row for each distinct set of ``ids``, and maybe some others; ``least`` name groups of similar sets.

    ``rows`` are those of ``marked``; texts of other sets are passed over unread.
    """
    named = F.xxhash64("doc_id")
    wanted = rows.filter("n > 0").join(ids, "id", "left_semi").groupBy("mark").agg(F.min(named).alias("id")).select("id").distinct()
    sent = df.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def work(batch):
        bits = sent.value
        names = batch.column(0).to_numpy().view(np.uint64) & np.uint64(len(bits) * 64 - 1)
        batch = batch.filter(pa.array((bits[(names >> np.uint64(6)).astype(np.int64)] >> (names & np.uint64(63)) & np.uint64(1)).astype(bool)))
        for _, sets in _sets(batch, 1, shingle) if batch.num_rows else ():
            made = []
            for tokens in sets:
                if len(tokens):
                    mark = _mark(tokens)
                    least = [int(mixed(tokens ^ s).min().view(np.int64)) for s in _SEEDS]
                    made.append((mark.hex(), _short(mark), len(tokens), *least, tokens.view(np.int64)))
            if made:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=["mark", "id", "n", "least_0", "least_1", "tokens"])

    sent_rows = df.select(F.xxhash64(column(id_col)).alias("name"), text_of(text_col).alias("text"))
    found = map_batches(sent_rows, work, "mark string, id bigint, n bigint, least_0 bigint, least_1 bigint, tokens array<bigint>")
    return found.groupBy("mark").agg(*[F.first(c).alias(c) for c in ("id", "n", "least_0", "least_1", "tokens")])


# --- links inside groups and between them -------------------------------------
class Sets:
    """Some sets of tokens in one piece, to compare others with."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        self.starts = np.cumsum(self.sizes) - self.sizes
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.union, self.ids = np.unique(flat, return_inverse=True)
        self.marked = np.zeros(len(self.union), bool)

    def own(self, tokens: np.ndarray) -> np.ndarray:
        """Which of the union's tokens these are; tokens outside of it are left out."""
        at = np.searchsorted(self.union, tokens)
        at[at == len(self.union)] = 0
        return at[self.union[at] == tokens] if len(self.union) else at[:0]

    def linked(self, own: np.ndarray, n: int, which: np.ndarray, percent: int) -> np.ndarray:
        """Those of the sets ``which`` that are alike to a set of ``n`` tokens of which ``own`` are in the union."""
        small, large = np.minimum(self.sizes[which], n), np.maximum(self.sizes[which], n)
        which = which[small * 100 >= large * percent]  # a set shares at most the smaller one, of at least the larger one
        if not len(which):
            return which
        m = self.sizes[which]
        ends = np.cumsum(m)
        self.marked[own] = True
        hits = np.concatenate([[0], np.cumsum(self.marked[self.ids[np.arange(int(ends[-1])) + np.repeat(self.starts[which] - (ends - m), m)]])])
        self.marked[own] = False
        shared = hits[ends] - hits[ends - m]
        return which[shared * 100 >= (n + m - shared) * percent]


def links_inside(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect what all alike pairs connect; sets that are connected already are not compared."""
    block, label, out = Sets(sets), np.arange(len(sets)), []
    for x in range(len(sets)):
        others = np.arange(x + 1, len(sets))
        others = others[label[others] != label[x]]
        if not len(others):
            continue
        own = block.ids[block.starts[x] : block.starts[x] + block.sizes[x]]
        found = block.linked(own, int(block.sizes[x]), others, percent)
        met, first = np.unique(label[found], return_index=True)
        out += [(x, int(y)) for y in found[first]]
        label[np.isin(label, met)] = label[x]
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, int, int, bool]]:
    """Slices (batch, from, to, first) of equal values in the first ``keys`` columns; ``first`` where a new run begins."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True))
        start = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or values[i] != values[start]:
                yield batch, start, i, values[start] != last
                last = values[start]
                start = i


def _pieces(members: DataFrame, key: str) -> DataFrame:
    """``members`` with ``pieces``, into how many its group is cut. Only the groups that are cut are looked up: one for each ``BLOCK_SETS`` sets at most."""
    counts = members.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("sum"))
    pieces = F.greatest(F.ceil(F.col("rows") / BLOCK_SETS), F.ceil(F.col("sum") / BLOCK_TOKENS))
    cut = cut_lineage(counts.select(F.col(key).alias("cut"), pieces.alias("pieces")).filter("pieces > 1"))
    return members.join(cut, F.col(key) == F.col("cut"), "left").drop("cut").withColumn("pieces", F.coalesce("pieces", F.lit(1)))


def link_groups(members: DataFrame, key: str, salt: int, percent: int = PERCENT) -> DataFrame:
    """(a, b): links that connect what all alike pairs of one piece of a group connect."""

    def compare(batches):
        held: list[tuple[str, np.ndarray]] = []

        def flush():
            if len(held) > 1:
                found = links_inside([h[1] for h in held], percent)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([held[p[side]][0] for p in found], pa.string()) for side in (0, 1)], names=["a", "b"])

        for batch, start, end, first in _runs(batches, 2):
            if first:
                yield from flush()
                held = []
            held += [(batch.column(2)[i].as_py(), _tokens(batch.column(3), i)) for i in range(start, end)]
        yield from flush()

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.pmod(F.xxhash64("mark", F.lit(salt)), F.col("pieces")).alias("block")
    rows = _pieces(members, key).select(key, block, "mark", "tokens")
    return rows.repartition(n, key, "block").sortWithinPartitions(key, "block").mapInArrow(compare, "a string, b string")


def _left(tokens: DataFrame, percent: int) -> DataFrame:
    """(id, smallest, largest): how many tokens a set of another component may have to be linked with this one, told by how many of its tokens are left; no row where none can."""
    smallest = F.ceil(F.col("n") * percent / 100)
    largest = F.expr(f"({100 + percent} * left - {percent} * n) div {percent}")  # with x shared, both sets together have at most x (100 + percent) / percent
    return tokens.groupBy("id", "n", "class").agg(F.count(F.lit(1)).alias("left")).select("id", smallest.alias("smallest"), largest.alias("largest")).filter("smallest <= largest")


def _size_class(n: str) -> Column:
    return F.floor(F.log(F.col(n).cast("double")) / math.log(SIZE_STEP)).cast("int")


def shared_tokens(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, n, class, token): the sets that may still be linked with a set of another component, and of their tokens those that such sets may share; ``class`` names the component.

    A token counts for a set if a set of another component has it, which may be linked with a set of this size and is of a size this one may be linked with.
    Sets are left out when too few of their tokens count, their tokens then count for no other set, and so on in rounds until little changes. A set and one it is linked with keep
    all they share through every round, so no link is lost; a token makes one row for each set and size class, however many sets have it.
    """
    tokens = members.select("id", "n", F.xxhash64("component").alias("class"), F.explode("tokens").alias("token"))
    several = tokens.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high")
    tokens = cut_lineage(tokens.join(several, "token", "left_semi"))
    before, now = math.inf, tokens.count()
    for _ in range(ROUNDS):
        if not now or now > before * 0.9:
            break
        open_ = cut_lineage(tokens.join(cut_lineage(_left(tokens, percent)), "id"))
        sizes = F.explode(F.sequence(_size_class("smallest"), _size_class("largest")))
        held = open_.select("token", "class", "n", sizes.alias("size")).groupBy("token", "size")
        held = held.agg(F.min("class").alias("low"), F.max("class").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
        met = open_.withColumn("size", _size_class("n")).join(held, ["token", "size"]).filter("(low <> class or high <> class) and least <= largest and most >= smallest")
        tokens = cut_lineage(met.select("id", "n", "class", "token"))
        before, now = now, tokens.count()
    return cut_lineage(tokens.join(cut_lineage(_left(tokens, percent)), "id"))


def token_groups(members: DataFrame, tokens: DataFrame) -> DataFrame:
    """``members`` of ``tokens`` with ``group``, about ``GROUP_SETS`` in each: sets of a large component have groups of their own, others one for the least token they have left."""
    left = tokens.groupBy("id", "class").agg(F.min(F.xxhash64("token")).alias("least"))
    large = cut_lineage(left.groupBy("class").agg(F.count(F.lit(1)).alias("sets")).filter(F.col("sets") >= GROUP_SETS)).select("class")
    named = left.join(large.withColumnRenamed("class", "large"), F.col("class") == F.col("large"), "left").select("id", F.coalesce("large", "least").alias("alike"))
    members = cut_lineage(members.join(cut_lineage(named), "id"))
    groups = max(1, -(-members.count() // GROUP_SETS))
    piece = F.pmod(F.xxhash64("mark", F.lit("group")), F.ceil(F.col("pieces") * (BLOCK_SETS / GROUP_SETS)))
    placed = F.when(F.col("pieces") > 1, F.xxhash64("alike", piece)).otherwise(F.xxhash64("alike"))
    return _pieces(members, "alike").withColumn("group", F.pmod(placed, F.lit(groups))).drop("pieces")


def candidate_groups(grouped: DataFrame, tokens: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(mark, group): for each set the groups whose union holds one of its rarest tokens and which have members of other components and of its size or more.

    The smaller of two linked sets shares all but so many of its tokens with the other, so one of any so many and one of them is among those. Those that few groups have are
    looked up; only ``tokens`` (``shared_tokens``) count.
    """
    placed = tokens.join(grouped.select("id", "mark", "group"), "id")
    matrix = cut_lineage(placed.groupBy("token", "group").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.max("n").alias("most"), F.min("n").alias("least")))
    useful = cut_lineage(matrix.groupBy("token").agg(F.count(F.lit(1)).alias("groups")))
    ranked = placed.join(useful, "token").groupBy("mark", "n", "class", "largest").agg(F.sort_array(F.collect_list(F.struct("groups", "token"))).alias("found"))
    probes = F.size("found") - F.expr(f"({2 * percent} * n + {99 + percent}) div {100 + percent}") + 1
    probing = ranked.filter(probes > 0).select("mark", "n", "class", "largest", F.explode(F.slice("found", F.lit(1), probes.cast("int"))).alias("t")).select("mark", "n", "class", "largest", "t.token")
    met = probing.join(matrix, "token").filter("(low <> high or low <> class) and most >= n and least <= largest")
    return met.select("mark", "group").distinct()


def open_groups(grouped: DataFrame, candidates: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links of sets with members, of other components, of the groups whose union holds enough of their tokens."""

    def compare(batches):
        group: Sets | None = None
        names: list[str] = []
        labels = np.zeros(0, np.int64)
        known: dict[str, int] = {}
        waiting: list[tuple[str, str, np.ndarray]] = []
        for batch, start, end, first in _runs(batches, 2):
            if first:
                group, waiting, known = None, [], {}
            roles = batch.column(2).to_pylist()
            for i in range(start, end):
                mark, component, tokens = batch.column(3)[i].as_py(), batch.column(4)[i].as_py(), _tokens(batch.column(5), i)
                if not roles[i]:
                    waiting.append((mark, component, tokens))
                    continue
                if group is None:
                    group, names = Sets([w[2] for w in waiting]), [w[0] for w in waiting]
                    labels = np.array([known.setdefault(w[1], len(known)) for w in waiting], np.int64)
                own = group.own(tokens)
                label = known.setdefault(component, len(known))
                others = np.flatnonzero(labels != label)
                if len(own) < needed(len(tokens), percent) or not len(others):
                    continue  # the union holds too few: no member is opened
                found = group.linked(own, len(tokens), others, percent)
                met, at = np.unique(labels[found], return_index=True)
                if len(met):
                    yield pa.RecordBatch.from_arrays([pa.array([mark] * len(at), pa.string()), pa.array([names[j] for j in found[at]], pa.string())], names=["a", "b"])
                    for value in met.tolist():
                        labels[labels == value] = label
                        known.update({c: label for c, v in known.items() if v == value})

    spark = grouped.sparkSession
    times = candidates.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / QUERIES_AT_ONCE).cast("int").alias("parts"))
    members = grouped.join(times, "group").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = candidates.join(times, "group").withColumn("part", F.pmod(F.xxhash64("mark"), F.col("parts")).cast("int"))
    asking = asked.join(grouped.select("mark", "component", "tokens"), "mark")
    names = ["group", "part", "role", "mark", "component", "tokens"]
    rows = members.withColumn("role", F.lit(0)).select(*names).unionByName(asking.withColumn("role", F.lit(1)).select(*names))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "group", "part").sortWithinPartitions("group", "part", "role").mapInArrow(compare, "a string, b string")


def linked_sets(df: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, percent: int = PERCENT, share: float = SHARE) -> DataFrame:
    """(node, root): for the mark of each set that is linked with another one, the smallest mark of its component. ``rows`` are those of ``marked``."""
    ids = cut_lineage(sharing_sets(df, text_col, shingle, percent, share))
    members = cut_lineage(members_of(df, rows, ids, id_col, text_col, shingle))
    links = cut_lineage(link_groups(members, "least_0", 0, percent).unionByName(link_groups(members, "least_1", 1, percent)))
    roots = components(links, "a", "b")
    placed = cut_lineage(members.select("mark", "id").join(roots.withColumnRenamed("node", "mark"), "mark", "left").select("id", "mark", F.coalesce("root", "mark").alias("component")))
    joined = members.join(placed.select("mark", "component"), "mark")
    between = _between(joined, percent, share)
    rest = cut_lineage(joined.join(cut_lineage(between), "id", "left_semi"))
    tokens = shared_tokens(rest, percent)
    grouped = cut_lineage(token_groups(rest, tokens))
    candidates = cut_lineage(candidate_groups(grouped, tokens, percent))
    return components(links.unionByName(open_groups(grouped, candidates, percent)), "a", "b")


def jaccard_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, percent: int = PERCENT, share: float = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``df``: its set's size, and the smallest id that links lead to.

    Sets are of distinct shingles of words; two are linked if they share at least ``percent`` of all tokens of both. No link is left out. Equal sets count
    once, so any number of copies costs no more than one. Rows without words are linked with nothing, not with each other either: their component is
    their own id. A null id has the smallest id of its component, null if there is none. Null text counts as empty; ids may repeat;
    other columns play no part; no rows give no rows. ``df`` should be a table: its texts are read three times, and tasks must see
    them in the same order each time.
    """
    rows = cut_lineage(marked(df, id_col, text_col, shingle))
    roots = linked_sets(df, rows, id_col, text_col, shingle=shingle, percent=percent, share=share)
    sets = rows.filter("n > 0").groupBy("mark").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    labelled = cut_lineage(sets.join(roots.withColumnRenamed("node", "mark"), "mark", "left").withColumn("root", F.coalesce("root", "mark")))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("sets"))
    named = join_by_key(labelled, least, "root", "sets").select("mark", "component_id", "rows")
    some = join_by_key(rows.filter("n > 0").drop("id"), cut_lineage(named), "mark", "rows")
    none = rows.filter("n = 0").drop("id").withColumn("component_id", F.col("doc_id"))
    return some.unionByName(none).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def jaccard_sql(shingle: int = SHINGLE, percent: int = PERCENT) -> str:
    """The same for DuckDB over ``documents``: every pair that shares a shingle."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(words) - {shingle - 1}, 1) + 1),
  lambda i: array_to_string(words[i : i + {shingle - 1}], ' '))) END AS shingles FROM w),
c AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY list_sort(shingles)) AS k, r, doc_id, shingles, len(shingles) AS n FROM s),
k AS MATERIALIZED (SELECT k, min(doc_id) AS first, any_value(shingles) AS shingles, any_value(n) AS n FROM c WHERE n > 0 GROUP BY k),
t AS MATERIALIZED (SELECT k, n, unnest(shingles) AS shingle FROM k),
l AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM t a JOIN t b ON a.shingle = b.shingle AND a.k < b.k GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
x(k, m) AS (SELECT k, k FROM k UNION SELECT e.b, x.m FROM x JOIN e ON x.k = e.a),
g AS (SELECT k, min(m) AS root FROM x GROUP BY k),
f AS (SELECT g.k, min(k.first) OVER (PARTITION BY g.root) AS component_id FROM g JOIN k ON g.k = k.k)
SELECT c.doc_id, CAST(c.n AS BIGINT) AS n_shingles, CASE WHEN c.n = 0 THEN c.doc_id ELSE f.component_id END AS component_id FROM c LEFT JOIN f ON c.k = f.k"""
