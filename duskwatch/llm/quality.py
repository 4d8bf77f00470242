"""Document quality by votes of the nearest labelled documents in a latent semantic space.

A text is counted as hashed byte trigrams and a few terms for its shape (repeated words, capitals, marks). A bounded sample of
labelled documents gives the terms' weights and the leading directions of their term space; the
sample's vectors in it are broadcast. Every document's vector is compared with all of them, in blocks, and the most similar
ones vote with their labels, weighted by similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import column, doc_slices, hashed_words, is_held_out, map_batches, text_of, utf8_parts, with_columns_in_python
from duskwatch.llm.labelled import labelled_sample

PER_CLASS = 2_500  # labelled documents of each label to learn from
TERMS = 2_048
SHAPES = 12
DIMENSIONS = 48
NEIGHBOURS = 25
SHARPNESS = 8.0  # power of the similarity in a vote
SHAPE_WEIGHT = 2.0
THRESHOLD = 0.3
BLOCK = 1_024  # documents compared at once


def term_counts(texts: pa.Array) -> np.ndarray:
    """Per text: counts of hashed byte trigrams (``TERMS``), then shares that tell its shape (``SHAPES``)."""
    data, starts = doc_slices(texts)
    n = len(texts)
    out = np.zeros((n, TERMS + SHAPES), np.float32)
    if not len(data):
        return out
    sizes = np.diff(starts)
    whose = np.repeat(np.arange(n), sizes)
    wide = data.astype(np.uint32)
    code = np.zeros(len(data), np.uint32)
    code[: len(data) - 2] = wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D) if len(data) > 2 else 0
    bucket = (code ^ code >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(21)
    inside = np.arange(len(data)) < (starts[1:] - 2)[whose]
    out[:, :TERMS] = np.bincount(whose[inside] * TERMS + bucket[inside], minlength=n * TERMS).reshape(n, TERMS)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    mark = ~letter & ~digit & ~blank & (data < 128)
    twice = np.zeros(len(data), bool)
    twice[1:] = (data[1:] == data[:-1]) & mark[1:]
    at, hashes = hashed_words(data, ~blank, starts)
    owner = whose[at]
    words = np.maximum(np.bincount(owner, minlength=n), 1)
    same = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((hashes, owner))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    bare = np.zeros(len(at), bool)  # words without a letter
    bare[:] = ~np.logical_or.reduceat(letter | (data >= 128), at) if len(at) else False
    share = lambda mask, of: np.bincount(whose[mask], minlength=n) / np.maximum(of, 1)
    shapes = [
        share(upper, np.bincount(whose[letter], minlength=n)), share(mark, sizes), share(digit, sizes), share(data >= 128, sizes), share(data == 10, words), share(twice, sizes),
        np.bincount(owner[1:][same], minlength=n) / words, 1 - np.bincount(owner[order][fresh], minlength=n) / words, np.bincount(owner[bare], minlength=n) / words,
        words / np.maximum(sizes, 1), 1 / np.sqrt(np.maximum(words, 1)), share(mark & (data == 46), words),
    ]
    out[:, TERMS:] = np.stack(shapes, axis=1)
    return out


class Space:
    """Weights and directions of the term space, and the labelled vectors in it."""

    def __init__(self, terms: np.ndarray, labels: np.ndarray, counts: dict[int, int], seed: int = 11):
        n = len(terms)
        self.labels = labels.astype(np.float32)
        # A label drawn less often than it occurs weighs as much as it occurs.
        drawn = np.maximum(np.bincount(labels, minlength=2), 1)
        self.weights = np.array([max(counts.get(c, 0), 1) / drawn[c] for c in (0, 1)], np.float32)[labels] if n else np.zeros(0, np.float32)
        self.prior = counts.get(1, 0) / max(sum(counts.values()), 1) if counts else 0.5
        present = (terms[:, :TERMS] > 0).sum(0) if n else np.zeros(TERMS)
        self.idf = np.log((1 + n) / (1 + present)).astype(np.float32)
        shapes = terms[:, TERMS:]
        self.middle = shapes.mean(0) if n else np.zeros(SHAPES, np.float32)
        self.spread = np.maximum(shapes.std(0), 1e-4) if n else np.ones(SHAPES, np.float32)
        weighed = self._weighed(terms)
        rng = np.random.default_rng(seed)
        width = min(DIMENSIONS, max(n, 1), weighed.shape[1])
        basis = rng.normal(size=(weighed.shape[1], width)).astype(np.float32)
        for _ in range(4):  # power iterations towards the leading directions
            basis, _ = np.linalg.qr(weighed.T @ (weighed @ basis)) if n else (np.linalg.qr(basis)[0], None)
        self.basis = basis.astype(np.float32)
        self.vectors = self._unit(weighed @ self.basis)

    def _weighed(self, terms: np.ndarray) -> np.ndarray:
        grams = terms[:, :TERMS] * self.idf
        grams /= np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-6)
        shapes = np.clip((terms[:, TERMS:] - self.middle) / self.spread, -4, 4) * (SHAPE_WEIGHT / SHAPES)
        return np.concatenate([grams, shapes], axis=1).astype(np.float32)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """The weighted share of label 1 among the nearest labelled vectors; without any, the share among all labels."""
        if not len(self.vectors):
            return np.full(len(terms), self.prior)
        own = self._unit(self._weighed(terms) @ self.basis)
        k = min(NEIGHBOURS, len(self.vectors))
        out = np.zeros(len(terms))
        for i in range(0, len(own), BLOCK):
            near = own[i : i + BLOCK] @ self.vectors.T
            best = np.argpartition(near, -k, axis=1)[:, -k:]
            alike = np.take_along_axis(near, best, axis=1).clip(1e-3) ** SHARPNESS * self.weights[best]
            out[i : i + BLOCK] = (alike * self.labels[best]).sum(1) / alike.sum(1)
        return out.clip(0.0, 1.0)


def squeezed_counts(texts: pa.Array) -> np.ndarray:
    """Term counts as the space takes them: trigrams by the logarithm of their count."""
    terms = term_counts(texts)
    np.log1p(terms[:, :TERMS], out=terms[:, :TERMS])
    return terms


def fit_space(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Space:
    """Learns from at most 2 x ``per_class`` labelled rows outside the held-out fold; their term counts (4 KB each) come to the driver."""
    sample, counts = labelled_sample(docs, labels, "quality", per_class, id_col, text_col)

    def work(batch):
        for part in utf8_parts(batch, "text"):
            counted = squeezed_counts(part.column(0)).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in counted], pa.binary()), part.column(1)], names=["terms", "label"])

    rows = map_batches(sample, work, "terms binary, label int").toArrow()
    terms = np.frombuffer(b"".join(rows["terms"].to_pylist()), np.float16).reshape(-1, TERMS + SHAPES).astype(np.float32)
    return Space(terms, rows["label"].to_numpy().astype(np.int64), counts)


def with_quality(docs: DataFrame, space: Space, score_col: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1, higher where label 1 is likelier; null text counts as empty, and empty texts are scored like any other."""
    sent = docs.sparkSession.sparkContext.broadcast(space)
    return with_columns_in_python(docs, text_col, lambda texts: [pa.array(sent.value.scores(squeezed_counts(texts)), pa.float64())], [(score_col, "double")])


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted (1 from ``threshold`` on).

    Nothing but the text is scored. Null ids are not held out; ids may repeat; other columns play no part. Without labels all
    scores are 0.5; without rows there is no result.
    """
    space = fit_space(docs, labels, id_col=id_col, text_col=text_col)
    rows = docs.select(column(id_col).alias("doc_id"), is_held_out(column(id_col)).alias("held_out"), text_of(text_col).alias("text"))
    return with_quality(rows, space).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, all columns."""
    names = [column(c) for c in docs.columns]
    score = "__quality"
    return with_quality(docs, fit_space(docs, labels, id_col=id_col, text_col=text_col), score, text_col).filter(F.col(score) >= threshold).select(*names)
