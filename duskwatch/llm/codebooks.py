"""Vector compression by codebooks of integer parts, each part's nearest entry found by equal-average search.

Vectors become integers and are cut into parts; every part position has a codebook of a few entries. A part's sum says how near an entry can be:
their squared distance is at least the squared gap of their sums over the number of components. Entries are sorted
by sum and visited outward from the part's own sum until the gap alone exceeds the best distance. Sums and counts of
all parts of an entry are exact integers, so codebooks do not depend on how rows are dealt to tasks.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import column, cut_lineage, join_by_key, map_batches

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
LARGEST = 1e27  # components are held within this on either side, so that sums of many rows stay exact
LONG_MAX = 2**63 - 1


def quantised(values: np.ndarray) -> np.ndarray:
    """floor(4096 x), as 64-bit integers where they are small, else as Python integers."""
    scaled = np.clip(np.floor(values.astype(np.float64) * SCALE), -LARGEST, LARGEST)
    if not len(scaled) or np.abs(scaled).max(initial=0.0) < 2.0**53:
        return scaled.astype(np.int64)
    return np.array([int(x) for x in scaled.ravel().tolist()], object).reshape(scaled.shape)


def _fits(width: int, *arrays: np.ndarray) -> bool:
    """Squared sums of ``width`` differences, times ``width``, stay within 64 bits."""
    most = 2**30 // max(1, width)
    return all(x.dtype != object and (not x.size or int(np.abs(x).max()) <= most) for x in arrays)


def nearest_entries(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each part (row) the nearest entry and its squared distance, ties to the lower index; and how many distances were computed."""
    width = parts.shape[1]
    if not _fits(width, parts, entries):
        parts, entries = parts.astype(object), entries.astype(object)
    sums, own = entries.sum(1), parts.sum(1)
    order = np.argsort(sums, kind="stable")
    sums = sums[order]
    right = np.searchsorted(sums, own)
    left = right - 1
    at = np.arange(len(parts))
    best = which = None
    computed = 0
    while len(at):
        low, high = left[at], right[at]
        down = own[at] - sums[np.maximum(low, 0)]
        up = sums[np.minimum(high, len(sums) - 1)] - own[at]
        take_low = (high >= len(sums)) | ((low >= 0) & (down <= up))
        gap = np.where(take_low, down, up)
        more = (low >= 0) | (high < len(sums))
        if best is not None:
            more &= (gap * gap <= best[at] * width).astype(bool)
        at, take_low, low, high = at[more], take_low[more], low[more], high[more]
        entry = order[np.where(take_low, low, high)]
        apart = parts[at] - entries[entry]
        distance = (apart * apart).sum(1)
        computed += len(at)
        if best is None:  # every part has a first entry
            best, which = distance, entry
        else:
            better = (distance < best[at]) | ((distance == best[at]) & (entry < which[at]))
            best[at[better]], which[at[better]] = distance[better], entry[better]
        left[at[take_low]] -= 1
        right[at[~take_low]] += 1
    return which, best, computed


def _edges(length: int, parts: int) -> list[int]:
    """Where parts begin and the last ends; equal parts if the length divides."""
    return [length * i // parts for i in range(parts + 1)]


def _by_length(lists: pa.Array):
    """(length, positions of the rows, their vectors) for each length in a batch."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for length in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == length)
        yield length, rows, flat[offsets[rows][:, None] + np.arange(length)[None, :]]


def usable(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, vector) of the rows whose vector is not null and holds finite numbers only."""
    vector = column(vector_col).cast("array<double>")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(column(id_col).alias("vec_id"), column(label_col).alias("label"), vector.alias("vector")).filter(F.col("vector").isNotNull() & ~bad)


Codebooks = dict[int, list[np.ndarray]]


def first_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """For each length of vectors, each part's entries: those of the smallest ids (null ids last), then of the smaller vector."""
    books: Codebooks = {}
    for length in sorted(r["n"] for r in rows.select(F.size("vector").alias("n")).distinct().collect()):
        first = rows.filter(F.size("vector") == length).orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
        whole = quantised(np.array([r["vector"] for r in first], np.float64).reshape(len(first), length))
        edges = _edges(length, parts)
        books[length] = [whole[:, a:b] for a, b in zip(edges, edges[1:], strict=False)]
    return books


def improved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry replaced by the componentwise floor of the mean of its parts; entries without parts stay."""
    sent = rows.sparkSession.sparkContext.broadcast(books)  # a few entries for each length of vectors, whatever the rows

    def add(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for length, _, vectors in _by_length(batch.column(0)):
                whole, edges = quantised(vectors), _edges(length, len(sent.value[length]))
                for i, book in enumerate(sent.value[length]):
                    part = whole[:, edges[i] : edges[i + 1]]
                    which, _, _ = nearest_entries(part, book)
                    total = sums.setdefault((length, i), np.zeros((len(book), part.shape[1] + 1), object))
                    for entry in np.unique(which).tolist():
                        own = part[which == entry]
                        total[entry, 0] += len(own)
                        total[entry, 1:] += own.sum(0).astype(object)
        cells = [(length, i, entry, at, Decimal(int(x))) for (length, i), total in sums.items() for entry, line in enumerate(total) if line[0] for at, x in enumerate(line)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0))
        if cells:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*cells, strict=True), kinds, strict=True)], names=["length", "part", "entry", "at", "total"])

    found = rows.select("vector").mapInArrow(add, "length int, part int, entry int, at int, total decimal(38,0)")
    summed = {(r["length"], r["part"], r["entry"], r["at"]): int(r["total"]) for r in found.groupBy("length", "part", "entry", "at").agg(F.sum("total").alias("total")).collect()}
    made: Codebooks = {}
    for length, old in books.items():
        made[length] = []
        for i, book in enumerate(old):
            new = book.astype(object)
            for entry in range(len(book)):
                n = summed.get((length, i, entry, 0), 0)
                if n:
                    new[entry] = [summed[length, i, entry, at + 1] // n for at in range(book.shape[1])]
            made[length].append(new.astype(np.int64) if all(abs(x) < 2**53 for x in new.ravel().tolist()) else new)
    return made


def digest(book: list[np.ndarray]) -> str:
    """SHA-256 of all integers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for part in book for x in part.ravel().tolist()).encode()).hexdigest()


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of ``rows`` (vec_id, label, vector) after all rounds; each round reads all rows once and hands on one small row for each sum."""
    books = first_codebooks(rows, parts, entries)
    for _ in range(rounds if books else 0):
        books = improved(rows, books)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, length, code, error) of each row: its parts' entries as two hex digits each, and its squared distance from them."""
    sent = rows.sparkSession.sparkContext.broadcast(books)
    kinds = [rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")]

    def work(batch):
        codes, errors, lengths = np.full(batch.num_rows, "", object), np.zeros(batch.num_rows, object), np.zeros(batch.num_rows, np.int32)
        for length, at, vectors in _by_length(batch.column(2)):
            whole, edges = quantised(vectors), _edges(length, len(sent.value[length]))
            lengths[at] = length
            for i, book in enumerate(sent.value[length]):
                which, distance, _ = nearest_entries(whole[:, edges[i] : edges[i + 1]], book)
                codes[at] += np.array([f"{e:02x}" for e in range(len(book))], object)[which]
                errors[at] += distance.astype(object)
        errors = [min(int(e), LONG_MAX) for e in errors]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths), pa.array(codes.tolist(), pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "length", "code", "error"])

    return map_batches(rows.select("vec_id", "label", "vector"), work, f"vec_id {kinds[0]}, label {kinds[1]}, length int, code string, error bigint")


def decode(code: str, book: list[np.ndarray]) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([part[int(code[2 * i : 2 * i + 2], 16)] for i, part in enumerate(book)]).astype(np.float64) / SCALE


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each row whose vector is not null and all finite; the others go.

    Each length of vectors has codebooks of its own (parts of a length that does not divide are cut as evenly as can be), with fewer
    entries if there are fewer vectors. Null ids come last when entries are chosen, rows of one id by their vector. ``label_error`` adds up
    over equal labels, nulls together. Repeated rows count each; errors beyond a long are the largest long; components beyond 1e27 / 4096 count as
    that; other columns play no part; no rows give no rows. ``df`` is read once for each round and twice more; one that is
    costly to make should be written first.
    """
    rows = usable(df, id_col, vector_col, label_col)
    books = fit(rows, parts, entries, rounds)
    coded = cut_lineage(encode(rows, books))
    totals = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count(F.lit(1)).alias("rows"))
    totals = cut_lineage(totals.select("label", F.least("total", F.lit(LONG_MAX)).cast("bigint").alias("label_error"), "rows"))
    joined = join_by_key(coded, totals, "label", "rows")
    shas = F.lit("")
    for length, book in books.items():
        shas = F.when(F.col("length") == length, digest(book)).otherwise(shas)
    return joined.select("vec_id", "code", "error", "label_error", shas.alias("codebooks_sha256"))


def codebook_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same for DuckDB over ``embeddings`` of one length: every distance of every round."""
    steps = [
        f"""k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT vec_id, label, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS c FROM k, (SELECT unnest(range({parts})) AS part) n)",
        f"e0 AS MATERIALIZED (SELECT part, entry, c FROM (SELECT part, c, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) t WHERE entry < {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""d{r} AS (SELECT p.vec_id, p.label, p.part, p.c, e{r}.entry, list_sum(list_transform(range(1, len(p.c) + 1), lambda i: (p.c[i] - e{r}.c[i]) * (p.c[i] - e{r}.c[i]))) AS far
  FROM p JOIN e{r} ON p.part = e{r}.part)"""
        )
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, label, part, c, entry, far FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, part ORDER BY far, entry) AS place FROM d{r}) t WHERE place = 1)")
        if r < rounds:
            steps.append(f"u{r} AS (SELECT part, entry, i, CAST(sum(c[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(c)) FROM p) + 1)) AS i) x GROUP BY part, entry, i)")
            steps.append(f"m{r} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM u{r} GROUP BY part, entry)")
            steps.append(f"e{r + 1} AS MATERIALIZED (SELECT e{r}.part, e{r}.entry, coalesce(m{r}.c, e{r}.c) AS c FROM e{r} LEFT JOIN m{r} ON e{r}.part = m{r}.part AND e{r}.entry = m{r}.entry)")
    steps.append(f"b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM e{rounds})")
    steps.append(f"f AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label)")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f, b"
