"""Alignment of two tokenizers' tokens over whole texts, anchored at white space.

Both tokenizers encode a text fully. Where a token of each ends at the same byte, the next bytes begin a new group of tokens. Such shared ends
that stand before a space-marked token are anchors: they split a text into windows, mostly single words, whose alignment depends
on their token ids alone. A window is aligned once and remembered by its ids; texts are put together from windows.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import column, cut_lineage, map_batches, text_of, utf8_parts

MEMO_WINDOWS = 200_000  # window alignments that a worker remembers
MEMO_TOKENS = 48  # longer windows hardly come again; they are aligned anew, which bounds what is remembered
PIECE_CHARS = 200_000  # longer texts are given to the piece tokenizer in parts that cannot merge with each other
PAIRS_HELD = 2_000_000  # counted links that a task holds before it adds them up
_MARK = "▁"
_BYTE_PIECE = re.compile(r"<0x([0-9A-Fa-f]{2})>")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ids = np.random.default_rng(20260401)
_TOKEN_KEYS = _ids.integers(1, 2**63, 1 << 16, dtype=np.uint64) | np.uint64(1)
_PLACE_KEYS = _ids.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself where printable, else one from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    """A byte-level BPE vocabulary in a tokenizers file; encodes a space and the text.

    The merges of such a file are in the order of the ids they make (checked), so ids are ranks and the rank encoder gives the
    file's own ids, several times as fast as the file's encoder. No special tokens: their strings are plain text.
    Every byte has a token (checked), so the tokens' bytes are always the text's.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)["model"]
        alphabet, vocab = byte_alphabet(), spec["vocab"]
        merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{os.path.basename(path)}: merges are not in the order of ids")
        special = set(vocab.values()) - set(merged)
        ranks = {bytes(alphabet[c] for c in piece): i for piece, i in vocab.items() if i not in special or len(piece) == 1}
        self.token_bytes = [b""] * (max(vocab.values()) + 1)
        for piece, i in ranks.items():
            self.token_bytes[i] = piece
        if len({p for p in ranks if len(p) == 1}) < 256:
            raise ValueError(f"{os.path.basename(path)}: not every byte has a token")
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.encoding.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]


class PieceTokens:
    """A sentencepiece vocabulary that puts a space before the text.

    Where no piece holds a space mark behind another character, tokens never cross the place before a single space between
    two other characters; very long texts are cut there, which bounds memory and changes no token.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        byte = [_BYTE_PIECE.fullmatch(p) if self.model.is_byte(i) else None for i, p in enumerate(pieces)]
        self.token_bytes = [bytes([int(m.group(1), 16)]) if m else p.replace(_MARK, " ").encode() for p, m in zip(pieces, byte, strict=True)]
        self.cuts = not any(_MARK in p.lstrip(_MARK) for p in pieces)

    def _parts(self, text: str) -> list[str]:
        if len(text) <= PIECE_CHARS or not self.cuts:
            return [text]
        parts, start = [], 0
        while len(text) - start > PIECE_CHARS and (cut := _CUT.search(text, start + PIECE_CHARS)):
            parts.append(text[start : cut.start()])
            start = cut.end()  # the space comes back as the one that is put before each part
        return [*parts, text[start:]]

    def encode(self, texts: list[str]) -> list[list[int]]:
        if all(len(t) <= PIECE_CHARS for t in texts):
            return self.model.encode(texts, num_threads=1)
        return [list(chain.from_iterable(self.model.encode(p) for p in self._parts(t))) for t in texts]


def shared_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of tokens in both streams that end at the same byte."""
    at = np.searchsorted(ends_b, ends_a)
    mine = np.flatnonzero(ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a)
    return mine, at[mine]


def _spots(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of runs that begin at ``starts``, one run after another."""
    return np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def _window_keys(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    place = np.arange(len(ids)) - np.repeat(starts, counts)
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys = (_TOKEN_KEYS[ids & 0xFFFF] ^ mixed) * _PLACE_KEYS[place & 63] + place.astype(np.uint64)
    keys ^= keys >> np.uint64(31)
    return np.add.reduceat(keys * np.uint64(0xBF58476D1CE4E5B9), starts)


def _same_as(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, chief: np.ndarray) -> bool:
    """Each window has the ids of its chief."""
    if not np.array_equal(counts, counts[chief]):
        return False
    place = np.arange(len(ids)) - np.repeat(starts, counts)
    return bool((ids == ids[np.repeat(starts[chief], counts) + place]).all())


class Aligner:
    """Aligns texts in a worker; remembers windows by their ids."""

    def __init__(self, first, second):
        self.first, self.second = first, second
        self.lengths = [np.array([len(x) for x in t.token_bytes], np.int64) for t in (first, second)]
        self.names = [f"{i}{mark}" for i in range(len(self.lengths[0])) for mark in ",|"] + [f"{i}{mark}" for i in range(len(self.lengths[1])) for mark in ",;"]
        self.marked = np.array([x[:1] == b" " for x in first.token_bytes])
        self.memo: dict[tuple, tuple] = {}
        self.aligned = 0

    def align(self, a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> list[tuple[str, tuple[int, ...]]]:
        """For each window its groups as text and its links as keys: the last tokens of each group, which end together.

        ``a`` and ``b`` are the windows' ids one after another, ``ends`` says how many ids of both stand before each window's end.
        """
        x, y = shared_ends(np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b]))
        in_a, in_b = np.diff(x, prepend=-1), np.diff(y, prepend=-1)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[x] = last_b[y] = 1
        # Tokens of each group in a row, the first tokenizer's before the second's, each with what stands behind it.
        before_a, before_b = (np.cumsum(last) - last for last in (last_a, last_b))  # groups that end before a token
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[before_a]] = 2 * a + last_a
        order[np.arange(len(b)) + np.cumsum(in_a)[before_b]] = 2 * b + last_b + 2 * len(self.lengths[0])
        words = list(map(self.names.__getitem__, order.tolist()))
        links = (a[x] << 32 | b[y]).tolist()
        group_ends = np.searchsorted(np.cumsum(in_a + in_b), ends, "right").tolist()
        out, start, first = [], 0, 0
        for end, group in zip(ends.tolist(), group_ends, strict=True):
            out.append(("".join(words[start:end])[:-1], tuple(links[first:group])))
            start, first = end, group
        return out

    def look_up(self, a: np.ndarray, b: np.ndarray, start_a: np.ndarray, count_a: np.ndarray, start_b: np.ndarray, count_b: np.ndarray) -> list[tuple[str, tuple[int, ...]]]:
        """The alignment of each of these windows, which differ from each other; new ones are aligned and remembered by their ids."""
        spots = [_spots(start_a, count_a), _spots(start_b, count_b)]
        plain_a, plain_b = a[spots[0]].tolist(), b[spots[1]].tolist()
        ends_a, ends_b = np.cumsum(count_a), np.cumsum(count_b)
        windows: list[tuple | None] = []
        i = j = 0
        for m, n in zip(ends_a.tolist(), ends_b.tolist(), strict=True):
            windows.append((tuple(plain_a[i:m]), tuple(plain_b[j:n])) if m - i + n - j <= MEMO_TOKENS else None)
            i, j = m, n
        found = list(map(self.memo.get, windows))  # None is no key
        new = [i for i, f in enumerate(found) if f is None]
        if new:
            m, n = count_a[new], count_b[new]
            made = self.align(a[_spots(start_a[new], m)], b[_spots(start_b[new], n)], np.cumsum(m + n))
            self.aligned += len(new)
            for i, f in zip(new, made, strict=True):
                found[i] = f
            kept = [(windows[i], f) for i, f in zip(new, made, strict=True) if windows[i] is not None][:MEMO_WINDOWS]
            if len(self.memo) + len(kept) > MEMO_WINDOWS:
                self.memo.clear()
            self.memo.update(kept)
        return found

    def tokens(self, texts: list[str]) -> tuple[list, list]:
        """Token ids of each text by both; none where the text is empty or a tokenizer's bytes are not a space and the text."""
        a, b = self.first.encode(texts), self.second.encode(texts)
        token_bytes = self.second.token_bytes.__getitem__
        for i, text in enumerate(texts):
            if not text or b"".join(map(token_bytes, b[i])) != b" " + text.encode():
                a[i], b[i] = (), ()
        return a, b

    def windows(self, a: np.ndarray, b: np.ndarray, doc_a: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where windows begin in both streams, which are texts' ids one after another; ``doc_a`` is where texts end in the first."""
        x, y = shared_ends(np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b]))
        anchor = np.append(self.marked[a[1:]], True)
        anchor[doc_a[doc_a > 0] - 1] = True
        anchor = anchor[x]
        return np.concatenate([[0], x[anchor][:-1] + 1]), np.concatenate([[0], y[anchor][:-1] + 1])

    def texts(self, texts: list[str]):
        """For each text: tokens by both, groups, digest of the groups, and its links as keys (first id in the high half) with their numbers."""
        by_a, by_b = self.tokens(texts)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(texts)) for x in (by_a, by_b))
        groups, digests = np.zeros(len(texts), np.int64), [""] * len(texts)
        no_links = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64))
        if not n_a.sum():
            return n_a, n_b, groups, digests, no_links
        a = np.concatenate([x for x in by_a if len(x)]).astype(np.int64)
        b = np.array(list(chain.from_iterable(by_b)), np.int64)
        ends_a = np.cumsum(n_a)
        start_a, start_b = self.windows(a, b, ends_a)
        count_a, count_b = np.diff(np.append(start_a, len(a))), np.diff(np.append(start_b, len(b)))
        keys = _window_keys(a, start_a, count_a) * np.uint64(3) ^ _window_keys(b, start_b, count_b)
        _, chief, code = np.unique(keys, return_index=True, return_inverse=True)
        if not (_same_as(a, start_a, count_a, chief[code]) and _same_as(b, start_b, count_b, chief[code])):  # two windows of one key
            seen: dict[tuple, int] = {}
            code = np.array([seen.setdefault((a[i : i + m].tobytes(), b[j : j + n].tobytes()), len(seen)) for i, m, j, n in zip(start_a, count_a, start_b, count_b, strict=True)])
            chief = np.unique(code, return_index=True)[1]
        found = self.look_up(a, b, start_a[chief], count_a[chief], start_b[chief], count_b[chief])
        fragments = [f[0] for f in found]
        many = np.array([len(f[1]) for f in found], np.int64)
        pairs = np.fromiter(chain.from_iterable(f[1] for f in found), np.int64)
        offsets = np.cumsum(many) - many
        # Links of all windows in order, then counted for each text.
        of_window = many[code]
        linked = pairs[_spots(offsets[code], of_window)]
        first_window = np.searchsorted(start_a, ends_a - n_a)
        bounds = np.append(first_window, len(start_a))
        link_ends = np.concatenate([[0], np.cumsum(of_window)])[bounds]
        groups = np.diff(link_ends)
        coded = code.tolist()
        for i in np.flatnonzero(n_a).tolist():
            own = ";".join(map(fragments.__getitem__, coded[bounds[i] : bounds[i + 1]]))
            digests[i] = hashlib.sha256(own.encode()).hexdigest()
        kinds, numbers = np.unique(linked, return_inverse=True)
        cells, times = np.unique(np.repeat(np.arange(len(texts)), groups) * len(kinds) + numbers, return_counts=True)
        return n_a, n_b, groups, digests, (kinds[cells % len(kinds)], times, np.searchsorted(cells, np.arange(len(texts) + 1) * len(kinds)))


_aligners: dict[tuple, Aligner] = {}


def pair_bound(first: list[bytes], second: list[bytes]) -> int:
    """How many id pairs can ever be linked. Tokens that end together are one a suffix of the other, which few pairs of a vocabulary are."""
    counts: dict[bytes, int] = {}
    for token in second:
        if token:
            counts[token] = counts.get(token, 0) + 1
    total = sum(counts.get(t[i:], 0) for t in first if t for i in range(len(t)))
    own: dict[bytes, int] = {}
    for token in first:
        if token:
            own[token] = own.get(token, 0) + 1
    return total + sum(own.get(t[i:], 0) for t in second if t for i in range(1, len(t)))


def aligned(df: DataFrame, make: Callable[[], tuple], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: doc_id, n_a, n_b, n_groups, groups_sha256, pairs, times.

    ``make`` gives both tokenizers in a worker. ``pairs`` are the text's distinct links (first id in the high 32 bits, second id in the low ones),
    ``times`` how often each occurs. Texts that are null, empty, or not given back by both tokenizers have zeros, '' and no pairs.
    """
    kind = df.schema[id_col].dataType.simpleString()
    key = getattr(make, "key", None) or (make.__module__, make.__qualname__)

    def work(batch):
        if key not in _aligners:
            _aligners[key] = Aligner(*make())
        for part in utf8_parts(batch, "text"):
            gc.disable()  # many small tuples and no cycles: collecting only costs time
            try:
                n_a, n_b, groups, digests, (pairs, times, bounds) = _aligners[key].texts(part.column(1).to_pylist())
            finally:
                gc.enable()
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, t)) for x, t in ((pairs, pa.int64()), (times, pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(x, pa.int64()) for x in (n_a, n_b, groups)), pa.array(digests, pa.string()), *lists],
                names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"],
            )

    rows = df.select(column(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return map_batches(rows, work, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, pairs array<bigint>, times array<int>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, links): how many links of all texts hold each id pair linked. Tasks add up what they see first."""

    def added(held):
        pairs, inverse = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        sums = np.zeros(len(pairs), np.int64)
        np.add.at(sums, inverse, np.concatenate([h[1] for h in held]))
        return pairs, sums

    def count(batches):
        held, n = [], 0
        for batch in batches:
            pairs, times = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(2))
            held.append((pairs, times.astype(np.int64)))
            n += len(pairs)
            if n >= PAIRS_HELD:
                held = [added(held)]
                n = len(held[0][0])
        if held:
            pairs, sums = added(held)
            for i in range(0, len(pairs), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + 100_000]), pa.array(sums[i : i + 100_000])], names=["pair", "links"])

    return rows.select("pairs", "times").mapInArrow(count, "pair bigint, links bigint").groupBy("pair").agg(F.sum("links").alias("links"))


class Vocabularies:
    """Both tokenizers by their files; sent to workers as paths."""

    def __init__(self, first: str, second: str, pattern: str):
        self.key = (first, second, pattern)

    def __call__(self):
        first, second, pattern = self.key
        return ByteTokens(first, pattern), PieceTokens(second)


def align_tokens(df: DataFrame, make: Callable[[], tuple], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Tokens of both are grouped between byte offsets where tokens of both end; the tokens that end there together are linked. ``count_sum`` adds up,
    over the text's links, how many links of the whole table hold the same ids; ``n_best`` counts the links whose pair is linked as often as
    any pair with its second id (ties count). Texts that are null, empty, or that a tokenizer does not give back as they are have zeros
    and ''. Repeated rows count each; ids may be null or repeat; other columns play no part; no rows give no rows.

    A text's groups and links are written once; the counts of pairs are what is broadcast, at most ``pair_bound`` rows whatever the data.
    """
    rows = cut_lineage(aligned(df, make, id_col, text_col))
    table = pair_counts(rows).toArrow()  # bounded by the vocabularies, see pair_bound
    pairs, links = (table.column(i).to_numpy() for i in range(2))
    order = np.argsort(pairs)
    pairs, links = pairs[order], links[order]
    best = np.zeros(int((pairs & 0xFFFFFFFF).max(initial=0)) + 1, np.int64)
    np.maximum.at(best, pairs & 0xFFFFFFFF, links)
    sent = df.sparkSession.sparkContext.broadcast((pairs, links, links == best[pairs & 0xFFFFFFFF]))

    def judge(batch):
        pairs, links, top = sent.value
        lists = batch.column(5)
        bounds = lists.offsets.to_numpy().astype(np.int64)
        own = lists.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]]
        times = batch.column(6).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.searchsorted(pairs, own)
        bounds = bounds - bounds[0]
        total, many = ([np.concatenate([[0], np.cumsum(x)]) for x in (links[at] * times, top[at] * times)] if len(own) else [np.zeros(1, np.int64)] * 2)
        sums, bests = total[bounds[1:]] - total[bounds[:-1]], many[bounds[1:]] - many[bounds[:-1]]
        groups = batch.column(3)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(3)), groups, groups, pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), batch.column(4)],
            names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
        )

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(rows, judge, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
