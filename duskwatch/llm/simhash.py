"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint's 64 bits are dealt to partitions, correlated bits to the same one. For each fingerprint the radius is
shared out among the partitions as units u_1 + ... + u_m = radius + 1: two fingerprints
within the radius agree in some partition i to within u_i - 1 bits. Units are shared by dynamic programming on what probing a
partition that far costs (keys looked up, and candidates estimated from a sample), so partitions where many
fingerprints look alike are probed less far or not at all. Candidates are verified on all 64 bits. How units are shared changes the work,
never the result.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import column, cut_lineage, doc_slices, keep_rows, map_batches, text_of, utf8_parts
from duskwatch.llm.components import components

SHINGLE = 3
RADIUS = 2
SAMPLE = 2048  # distinct fingerprints from which bits are grouped and candidates estimated
KEY_COST = 12.0  # of a key that is shuffled, in verified candidates
RUN_ROWS = 2_000_000  # rows that one key is meant to bring to a task; more are split
PAIRS_AT_ONCE = 2_000_000
ROWS_AT_ONCE = 400_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of words, A-Z in lower case, joined by a space; with fewer words, of all of them."""
    words = text.translate(_LOWER).split()  # white space here is 20 and 09 to 0D
    if not words:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    begins, ends = begins[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(begins, ends, strict=True)), np.uint64, len(begins))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the hashes of the text's shingles, repeats included; no words: zero."""
    hashes = shingle_hashes(text, shingle)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, digest: bool = False) -> DataFrame:
    """(doc_id, fp) for each row, fp as a signed 64-bit integer; also text_sha256 and n_bytes if asked for. Null text counts as empty."""
    kind = df.schema[id_col].dataType.simpleString()

    def work(batch):
        for part in utf8_parts(batch, "text"):
            data, starts = doc_slices(part.column(1))
            whole, starts = data.tobytes(), starts.tolist()
            texts = [whole[a:b] for a, b in zip(starts, starts[1:], strict=False)]
            fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            columns, names = [part.column(0), pa.array(fps)], ["doc_id", "fp"]
            if digest:
                columns += [pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(list(map(len, texts)), pa.int64())]
                names += ["text_sha256", "n_bytes"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = df.select(column(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return map_batches(rows, work, f"doc_id {kind}, fp bigint" + ", text_sha256 string, n_bytes bigint" * digest)


class ProbePlan:
    """How bits are grouped, and what probing costs, for ``count`` distinct fingerprints of which ``sample`` is a sample."""

    def __init__(self, sample: np.ndarray, count: int, radius: int, parts: int | None = None):
        self.radius, self.scale = radius, max(1.0, count / max(1, len(sample)))
        choices = [parts] if parts else range(min(2, radius + 1), min(radius + 2, 9))
        best = None
        for m in choices:
            self.groups = self._groups(sample, m)
            self.seen = [np.sort(self._values(sample, g)) for g in self.groups]
            units, costs = self.allocate(sample[:256])
            cost = float(costs.mean()) if len(costs) else 0.0
            if best is None or cost < best[0]:
                best = (cost, self.groups, self.seen)
            del units
        self.cost, self.groups, self.seen = best
        self.balls = [self._balls(len(g)) for g in self.groups]

    @staticmethod
    def _groups(sample: np.ndarray, m: int) -> list[list[int]]:
        """64 bits in ``m`` groups of nearly equal size: each takes a free bit, then again and again the free bit most correlated with its bits."""
        bits = (sample[:, None] >> np.arange(64, dtype=np.uint64)[None, :] & np.uint64(1)).astype(np.float64) if len(sample) else np.zeros((0, 64))
        spread = bits - bits.mean(0) if len(bits) else bits
        scale = np.sqrt((spread**2).sum(0)) if len(bits) else np.ones(64)
        like = np.abs(spread.T @ spread) / np.maximum(np.outer(scale, scale), 1e-9) if len(bits) else np.zeros((64, 64))
        free, groups = list(range(64)), []
        for i in range(m):
            size = 64 // m + (i < 64 % m)
            group = [free.pop(0)]
            while len(group) < size:
                gain = like[np.ix_(free, group)].sum(1)
                group.append(free.pop(int(gain.argmax())))
            groups.append(sorted(group))
        return groups

    @staticmethod
    def _values(fps: np.ndarray, group: list[int]) -> np.ndarray:
        out = np.zeros(len(fps), np.uint64)
        for i, bit in enumerate(group):
            out |= (fps >> np.uint64(bit) & np.uint64(1)) << np.uint64(i)
        return out

    def _balls(self, width: int) -> list[np.ndarray]:
        """Masks of exactly 0, 1, ... radius bits of a partition."""
        found = []
        for t in range(self.radius + 1):
            if found and len(found[-1]) > 200_000:
                break
            found.append(np.array([sum(1 << b for b in c) for c in combinations(range(width), t)], np.uint64))
        return found

    def allocate(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of each partition for each fingerprint, and their estimated cost: the cheapest way of radius + 1 units in all."""
        need, n = self.radius + 1, len(fps)
        best = np.full((n, need + 1), np.inf)
        best[:, 0] = 0
        chosen = []
        for group, seen in zip(self.groups, self.seen, strict=True):
            near = self._near(self._values(fps, group), seen)
            price, ball = np.zeros((n, need + 1)), 0.0
            size = 1.0
            for u in range(1, need + 1):
                t = u - 1
                if t:
                    size *= (len(group) - t + 1) / t
                ball += size if t else 1.0
                # What the sample shows, and for what it is too small to show as much as chance would bring.
                expected = np.maximum(near[:, min(t, near.shape[1] - 1)], len(seen) * ball / 2.0 ** len(group))
                price[:, u] = KEY_COST * ball + self.scale * expected
            total = np.full((n, need + 1), np.inf)
            pick = np.zeros((n, need + 1), np.int8)
            for whole in range(need + 1):
                for u in range(whole + 1):
                    cost = best[:, whole - u] + price[:, u]
                    better = cost < total[:, whole]
                    total[better, whole] = cost[better]
                    pick[better, whole] = u
            best = total
            chosen.append(pick)
        units, left = np.zeros((n, len(self.groups)), np.int8), np.full(n, need)
        for i in reversed(range(len(self.groups))):
            units[:, i] = chosen[i][np.arange(n), left]
            left = left - units[:, i]
        return units, best[:, need]

    def _near(self, values: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """How many sampled values are within 0, 1, ... radius bits of each of ``values``."""
        out = np.zeros((len(values), self.radius + 1))
        for i in range(0, len(values), 512):
            apart = np.bitwise_count(values[i : i + 512, None] ^ seen[None, :])
            for t in range(self.radius + 1):
                out[i : i + 512, t] = (apart <= t).sum(1)
        return out

    def keys(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, position in ``fps``, role): role 1 is looked up, 2 looks up, 3 both. A key holds the partition in its top bits."""
        units, _ = self.allocate(fps)
        keys, whose, roles = [], [], []
        everyone = np.arange(len(fps))
        for i, group in enumerate(self.groups):
            own, top = self._values(fps, group), np.uint64(i << 58)
            keys.append(own | top)
            whose.append(everyone)
            roles.append(np.where(units[:, i] > 0, 3, 1))
            for t in range(1, int(units[:, i].max(initial=0))):
                far = np.flatnonzero(units[:, i] > t)
                masks = self.balls[i][t]
                keys.append(((own[far][:, None] ^ masks[None, :]) | top).ravel())
                whose.append(np.repeat(far, len(masks)))
                roles.append(np.full(len(far) * len(masks), 2))
        return np.concatenate(keys), np.concatenate(whose), np.concatenate(roles).astype(np.int8)

    def splits(self, keys: np.ndarray, run_rows: int) -> np.ndarray:
        """Into how many parts each key's looked-up rows are dealt, by their estimated number."""
        out = np.ones(len(keys), np.int64)
        part, value = keys >> np.uint64(58), keys & np.uint64((1 << 58) - 1)
        for i, seen in enumerate(self.seen):
            own = part == i
            hits = np.searchsorted(seen, value[own], "right") - np.searchsorted(seen, value[own], "left")
            out[own] = np.where(hits > 1, np.maximum(1, np.ceil(hits * self.scale / run_rows)), 1)
        return out


def forest(a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Positions of links that connect what all links (a, b) connect, without circles, nearest links first."""
    if not len(a):
        return np.zeros(0, np.int64)
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label, kept = np.arange(len(nodes)), []
    at = np.lexsort((np.arange(len(a)), far))  # position by nearness, so the least rank is the nearest
    x, y = x[at], y[at]
    rank = np.arange(len(at))
    while len(rank):
        p, q = label[x], label[y]
        out = p != q
        x, y, rank, p, q = x[out], y[out], rank[out], p[out], q[out]
        if not len(rank):
            break
        first = np.full(len(nodes), len(at))
        np.minimum.at(first, p, rank)
        np.minimum.at(first, q, rank)
        use = np.unique(first[first < len(at)])
        kept.append(use)
        spot = np.searchsorted(rank, use)
        p, q = p[spot], q[spot]
        while True:  # hook components along the links used, then shorten
            low = np.minimum(label[p], label[q])
            before = label.copy()
            np.minimum.at(label, p, low)
            np.minimum.at(label, q, low)
            np.minimum.at(label, before[p], low)
            np.minimum.at(label, before[q], low)
            label = label[label]
            if np.array_equal(before, label):
                break
    return at[np.concatenate(kept)] if kept else np.zeros(0, np.int64)


def _verified(key: np.ndarray, fp: np.ndarray, role: np.ndarray, radius: int):
    """Arrays (a, b, far) of links among rows sorted by key: who looks up against who is looked up under the same key."""
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    run = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    there, asks = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    per_run = np.bincount(run[there], minlength=len(edges) - 1)
    begin = np.concatenate([[0], np.cumsum(per_run)])
    n = per_run[run[asks]]
    asks, n = asks[n > 0], n[n > 0]
    stops = np.cumsum(n)
    at = 0
    while at < len(asks):
        to = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        some, many = asks[at:to], n[at:to]
        at = to
        first = begin[run[some]]
        for low in range(0, int(many.max()), PAIRS_AT_ONCE):  # a single key may have more than that
            part = np.minimum(many - low, PAIRS_AT_ONCE).clip(0)
            left = np.repeat(some, part)
            offset = np.arange(len(left)) - np.repeat(np.cumsum(part) - part, part)
            right = there[np.repeat(first + low, part) + offset]
            far = np.bitwise_count(fp[left] ^ fp[right])
            hit = (far <= radius) & (fp[left] != fp[right])
            if hit.any():
                yield fp[left[hit]], fp[right[hit]], far[hit]


def links(classes: DataFrame, radius: int = RADIUS, parts: int | None = None, run_rows: int = RUN_ROWS) -> DataFrame:
    """(a, b, far): links between distinct fingerprints (column fp) that connect exactly what all pairs within ``radius`` bits connect.

    Every pair within the radius is found and verified; of those met together only a spanning forest of nearest links is passed on, so a crowd
    of fingerprints brings about as many rows as it has members, not as many as it has pairs. A key with more than
    ``run_rows`` rows is split over tasks.
    """
    spark = classes.sparkSession
    count = classes.count()
    drawn = classes.select("fp", F.xxhash64("fp").alias("h")).orderBy("h").limit(SAMPLE).collect()
    plan = ProbePlan(np.array([r["fp"] for r in drawn], np.int64).view(np.uint64), count, radius, parts)
    sent = spark.sparkContext.broadcast(plan)

    def spread(batch):
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(fps), 2_000):
            part = fps[i : i + 2_000]
            keys, whose, roles = sent.value.keys(part)
            splits = sent.value.splits(keys, run_rows)
            fp = part[whose]
            salt = np.where(roles == 2, 0, (fp * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % splits.astype(np.uint64)).astype(np.int64)
            more = np.flatnonzero((splits > 1) & (roles & 2 > 0))
            if len(more):  # who looks up such a key goes to each part of it
                times = splits[more]
                extra = np.repeat(more, times)
                parts_of = np.arange(len(extra)) - np.repeat(np.cumsum(times) - times, times)
                stay = np.ones(len(keys), bool)
                stay[more[roles[more] == 2]] = False
                only = parts_of != np.where(roles[extra] == 3, salt[extra], -1)
                extra, parts_of = extra[only], parts_of[only]
                keys, fp, salt, roles = np.concatenate([keys[stay], keys[extra]]), np.concatenate([fp[stay], fp[extra]]), np.concatenate([salt[stay], parts_of]), np.concatenate([roles[stay], np.full(len(extra), 2, np.int8)])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(fp.view(np.int64)), pa.array(roles)], names=["key", "salt", "fp", "role"])

    def verify(batches):
        held: list[tuple] = []
        rows = 0

        def flush(keys, fps, roles):
            for a, b, far in _verified(keys, fps, roles, radius):
                use = forest(a, b, far)
                yield pa.RecordBatch.from_arrays([pa.array(a[use].view(np.int64)), pa.array(b[use].view(np.int64)), pa.array(far[use].astype(np.int32))], names=["a", "b", "far"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, salt, fp, role = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            held.append((key.view(np.uint64) ^ (salt.astype(np.uint64) << np.uint64(34)), fp.view(np.uint64), role))
            rows += len(key)
            if rows >= ROWS_AT_ONCE:
                keys, fps, roles = (np.concatenate([h[i] for h in held]) for i in range(3))
                last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
                yield from flush(keys[:last], fps[:last], roles[:last])
                held, rows = [(keys[last:], fps[last:], roles[last:])], 0
        if held:
            yield from flush(*(np.concatenate([h[i] for h in held]) for i in range(3)))

    keyed = map_batches(classes.select("fp"), spread, "key bigint, salt int, fp bigint, role tinyint")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_keys = keyed.repartition(n, "key", "salt").sortWithinPartitions("key", "salt")
    return sorted_keys.mapInArrow(verify, "a bigint, b bigint, far int")


def _rooted(rows: DataFrame, radius: int, parts: int | None, run_rows: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (doc_id, fp): (fp, first, rows, root), one for each fingerprint, and (root, component_id, fps), one for each group that links make."""
    classes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")))
    roots = components(links(classes, radius, parts, run_rows), "a", "b")
    labelled = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "rows", F.coalesce("root", "fp").alias("root"))
    return labelled, labelled.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("fps"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, radius: int = RADIUS, parts: int | None = None, run_rows: int = RUN_ROWS) -> DataFrame:
    """One row for each row of ``df``: doc_id, fingerprint (16 hex digits), component_id, the smallest id that links of at most ``radius`` bits lead to.

    Fingerprints are linked, not documents, so any number of copies counts once. Null text counts as empty and has fingerprint
    zero, linked like any other. A null id has a component too, of the smallest id in it, null if it has none. Ids may repeat;
    other columns play no part; no rows give no rows.
    """
    rows = cut_lineage(fingerprints(df, id_col, text_col, shingle))
    labelled, least = _rooted(rows, radius, parts, run_rows)
    named = labelled.join(least, "root").select(F.col("fp").alias("of"), "component_id")
    return rows.join(named, F.col("fp") == F.col("of")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, radius: int = RADIUS, parts: int | None = None, run_rows: int = RUN_ROWS
) -> DataFrame:
    """The rows of ``df`` that stay, all columns: of each group of ``near_duplicates`` the row with the smallest id (null ids last).

    Of rows of that id the one with the smaller digest of its text stays, of rows alike in both any one. Null text counts as empty; texts without words are one
    group; other columns play no part; no rows give no rows.
    """
    rows = cut_lineage(fingerprints(df, id_col, text_col, shingle, digest=True))
    labelled, _ = _rooted(rows, radius, parts, run_rows)
    own = cut_lineage(rows.groupBy("fp", "doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("copies")))
    # The smallest id of each fingerprint, then the smallest digest, then the same of each group; null ids only if there is no other.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_sha256", "copies")
    first = own.groupBy("fp").agg(F.min(order).alias("stay"))
    stay = first.join(labelled.select("fp", "root"), "fp").groupBy("root").agg(F.min("stay").alias("stay")).select("stay.doc_id", "stay.text_sha256", "stay.copies")
    return keep_rows(df, cut_lineage(stay), id_col, text_col)
