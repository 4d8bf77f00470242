"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is read as words; each word's input joins an embedding of the word, the mean embedding of its character
four-grams, and how much more often toxic documents hold the word and its rarest character four- and five-grams. The network reads overlapping
windows of words in both directions, pools the states by attention and scores each window; the highest window makes the
document's score. It is trained here, in numpy, from document labels alone: windows that score
highest stand for their documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import column, doc_slices, hashed_words, is_held_out, text_of, with_columns_in_python
from duskwatch.llm.labelled import labelled_sample

PER_CLASS = 1_500  # labelled documents of each label to learn from
WINDOW, STRIDE = 32, 24  # words of a window, and from one window to the next
WORD_BUCKETS = GRAM_BUCKETS = 1 << 16
WORD_DIM, GRAM_DIM, PRIORS = 4, 4, 3
HIDDEN, ATTENTION = 8, 8
EPOCHS, LEAST_STEPS = 6, 300  # times that windows are chosen anew; steps in all, by going over them more than once if they are few
BATCH = 256  # windows of a training step
BLOCK = 4_096  # windows scored at once
SHRINK = 4.0  # documents of either label that a word is taken to be in besides those it is in
THRESHOLD = 0.5
TEXT_SLICE = 1_000_000  # bytes of text read at once
INPUTS = WORD_DIM + GRAM_DIM + PRIORS


class Words:
    """The words of some texts: their buckets, their character grams' buckets, and where each text's words lie."""

    def __init__(self, texts: pa.Array):
        data, starts = doc_slices(texts)
        n = len(texts)
        sizes = np.diff(starts)
        whose = np.repeat(np.arange(n), sizes)
        # Blanks between texts, so that no gram reaches over.
        byte = np.full(len(data) + 5 * (n + 1), 32, np.uint8)
        byte[np.arange(len(data)) + 5 * (whose + 1)] = data
        heads = starts[:-1] + 5 * np.arange(1, n + 1)
        byte[(byte >= 65) & (byte <= 90)] |= 32
        accented = np.zeros(len(byte), bool)
        accented[1:] = (byte[:-1] == 0xC3) & (byte[1:] >= 0x80) & (byte[1:] <= 0x9E)
        byte[accented] += 32
        word = (byte >= 128) | ((byte >= 97) & (byte <= 122)) | ((byte >= 48) & (byte <= 57))
        byte[~word] = 32
        at, hashes = hashed_words(byte, word, np.array([0, len(byte)]))
        self.words = (hashes % np.uint64(WORD_BUCKETS)).astype(np.int64)
        self.n = n
        self.first = np.searchsorted(at, np.append(heads, len(byte)))  # of each text
        number = np.repeat(np.arange(len(at) + 1), np.diff(np.concatenate([[0], at, [len(byte)]]))) - 1
        wide = byte.astype(np.uint32)
        # A gram ends at each place whose three (four) last bytes are in the word; a blank before them marks the word's start.
        three = word[2:] & word[1:-1] & word[:-2]
        code = (wide[2:] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[:-2] * np.uint32(0xC2B2AE3D))
        at4 = np.flatnonzero(three[1:]) + 3
        code4 = (code[at4 - 2] + wide[at4 - 3] * np.uint32(0x27D4EB2F)).astype(np.uint32)
        self.grams4, self.of4 = self._bucket(code4), number[at4]
        at5 = at4[word[at4 - 3]]
        code5 = (code[at5 - 2] + wide[at5 - 3] * np.uint32(0x27D4EB2F) + wide[at5 - 4] * np.uint32(0x165667B1)).astype(np.uint32)
        self.grams5, self.of5 = self._bucket(code5 ^ np.uint32(0x5BD1E995)), number[at5]

    @staticmethod
    def _bucket(code: np.ndarray) -> np.ndarray:
        code = (code ^ code >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
        return ((code ^ code >> np.uint32(12)) * np.uint32(0x297A2D39) >> np.uint32(16)).astype(np.int64)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(first word, words) of all overlapping windows of each text in order, and the text of each; a text without words has none."""
        counts = np.diff(self.first)
        per = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
        text = np.repeat(np.arange(self.n), per)
        place = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        begin = self.first[text] + place * STRIDE
        return np.stack([begin, np.minimum(begin + WINDOW, self.first[text + 1]) - begin], axis=1), text


def _grouped(reduce, values: np.ndarray, of: np.ndarray, n: int, empty: float) -> np.ndarray:
    """``reduce`` over runs of equal ``of`` (ascending); ``empty`` where there is none."""
    out = np.full((n, *values.shape[1:]), empty, np.float32)
    if len(of):
        begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        out[of[begin]] = reduce.reduceat(values, begin, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, priors: list[np.ndarray], seed: int = 5):
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.priors = [p.astype(np.float32) for p in priors]  # of words, four-grams, five-grams
        self.word = (0.1 * rng.normal(size=(WORD_BUCKETS, WORD_DIM))).astype(np.float32)
        self.gram = (0.1 * rng.normal(size=(GRAM_BUCKETS, GRAM_DIM))).astype(np.float32)
        self.p = {}
        for d in ("f", "b"):
            self.p |= {f"W{d}": init(INPUTS, 3 * HIDDEN), f"U{d}": init(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": init(2 * HIDDEN, ATTENTION), "a": np.zeros(ATTENTION, np.float32), "v": init(ATTENTION), "w": init(2 * HIDDEN), "o": np.zeros(1, np.float32)}
        self.slope, self.shift = 1.0, 0.0

    def inputs(self, words: Words, priors: list[np.ndarray] | None = None) -> np.ndarray:
        priors = priors or self.priors
        n = len(words.words)
        counts = np.maximum(np.bincount(words.of4, minlength=n), 1)[:, None]
        mean = _grouped(np.add, self.gram[words.grams4], words.of4, n, 0.0) / counts
        most4 = _grouped(np.maximum, priors[1][words.grams4], words.of4, n, 0.0)
        most5 = _grouped(np.maximum, priors[2][words.grams5], words.of5, n, 0.0)
        return np.concatenate([self.word[words.words], mean, priors[0][words.words][:, None], most4[:, None], most5[:, None]], axis=1).astype(np.float32)

    def _run(self, gates: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States of one direction from what the inputs give to the gates (windows x places x 3 hidden)."""
        u = self.p[f"U{d}"]
        h = np.zeros((len(gates), HIDDEN), np.float32)
        states = np.zeros((len(gates), gates.shape[1], HIDDEN), np.float32)
        for t in range(gates.shape[1]) if d == "f" else reversed(range(gates.shape[1])):
            g, uh = gates[:, t], h @ u
            zr = _sigmoid(g[:, : 2 * HIDDEN] + uh[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN :] + r * uh[:, 2 * HIDDEN :])
            m = mask[:, t, None]
            if keep is not None:
                keep.append((t, h, z, r, n, uh[:, 2 * HIDDEN :], m))
            h = h + m * (1 - z) * (n - h)
            states[:, t] = h
        return states

    def logits(self, x: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Scores of windows over the words' inputs ``x``; a window's places beyond its words are passed over."""
        gates = {d: x @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in ("f", "b")}
        out = np.zeros(len(windows), np.float32)
        for i in range(0, len(windows), BLOCK):
            part = windows[i : i + BLOCK]
            places = np.arange(WINDOW)[None, :]
            mask = (places < part[:, 1:]).astype(np.float32)
            at = np.minimum(part[:, :1] + places, len(x) - 1)
            states = np.concatenate([self._run(gates[d][at], mask, d) for d in ("f", "b")], axis=2)
            out[i : i + BLOCK] = self._pooled(states, mask)[0]
        return out

    def _pooled(self, states: np.ndarray, mask: np.ndarray):
        t = np.tanh(states @ self.p["A"] + self.p["a"])
        e = t @ self.p["v"] + (mask - 1) * 1e9
        e = np.exp(e - e.max(1, keepdims=True))
        weight = e / e.sum(1, keepdims=True)
        context = np.einsum("bt,bth->bh", weight, states)
        return context @ self.p["w"] + self.p["o"][0], context, weight, t

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the weighted logistic loss, for the parameters and the inputs (windows x places x inputs)."""
        p, kept, states = self.p, {"f": [], "b": []}, {}
        for d in ("f", "b"):
            states[d] = self._run(x @ p[f"W{d}"] + p[f"c{d}"], mask, d, kept[d])
        both = np.concatenate([states["f"], states["b"]], axis=2)
        logit, context, weight, t = self._pooled(both, mask)
        wrong = ((_sigmoid(logit) - y) * weights / len(y)).astype(np.float32)
        g = {"w": context.T @ wrong, "o": np.array([wrong.sum()], np.float32)}
        d_context = wrong[:, None] * p["w"]
        d_both = weight[:, :, None] * d_context[:, None, :]
        d_weight = np.einsum("bh,bth->bt", d_context, both)
        d_e = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
        g["v"] = np.einsum("bt,btk->k", d_e, t)
        d_t = d_e[:, :, None] * p["v"] * (1 - t**2)
        g["A"], g["a"] = np.einsum("bth,btk->hk", both, d_t), d_t.sum((0, 1))
        d_both = d_both + d_t @ p["A"].T
        d_x = np.zeros_like(x)
        for d, part in (("f", d_both[:, :, :HIDDEN]), ("b", d_both[:, :, HIDDEN:])):
            u, d_u, d_h = p[f"U{d}"], np.zeros_like(p[f"U{d}"]), np.zeros((len(x), HIDDEN), np.float32)
            d_gates = np.zeros((*x.shape[:2], 3 * HIDDEN), np.float32)
            for t_, h, z, r, n, un, m in reversed(kept[d]):
                d_h = d_h + part[:, t_]
                d_n = d_h * m * (1 - z) * (1 - n**2)
                d_z = -d_h * m * (n - h) * z * (1 - z)
                d_r = d_n * un * r * (1 - r)
                d_uh = np.concatenate([d_z, d_r, d_n * r], axis=1)
                d_gates[:, t_] = np.concatenate([d_z, d_r, d_n], axis=1)
                d_u += h.T @ d_uh
                d_h = d_h * (1 - m * (1 - z)) + d_uh @ u.T
            g[f"U{d}"], g[f"c{d}"] = d_u, d_gates.sum((0, 1))
            g[f"W{d}"] = np.einsum("bti,btg->ig", x, d_gates)
            d_x += d_gates @ p[f"W{d}"].T
        return g, d_x

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Of each text: its highest window's score as a probability; a text without words has the lowest."""
        best = self.best(Words(texts))
        return _sigmoid(self.slope * best + self.shift).astype(np.float64)

    def best(self, words: Words, priors: list[np.ndarray] | None = None) -> np.ndarray:
        windows, text = words.windows()
        best = np.full(words.n, -30.0, np.float32)
        if len(windows):
            np.maximum.at(best, text, self.logits(self.inputs(words, priors), windows))
        return best


def log_odds(words: list[Words], labels: np.ndarray) -> list[np.ndarray]:
    """For each bucket of words, four-grams and five-grams: the logarithm of how much oftener toxic documents hold it, shrunk towards none."""
    toxic = max(int(labels.sum()), 1)
    clean = max(int((labels == 0).sum()), 1)
    found = []
    for values, buckets in ((lambda w: w.words, WORD_BUCKETS), (lambda w: w.grams4, GRAM_BUCKETS), (lambda w: w.grams5, GRAM_BUCKETS)):
        counts = np.zeros((2, buckets))
        for w, y in zip(words, labels, strict=True):
            counts[y, np.unique(values(w))] += 1
        rate = np.log((counts[1] / toxic + SHRINK / clean) / (counts[0] / clean + SHRINK / clean))
        found.append(np.clip(rate, -2, 4).astype(np.float32))
    return found


def train(texts: list[str], labels: np.ndarray, class_counts: dict[int, int] | None = None, epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Learns windows from labelled documents: of a toxic one its highest window, of a clean one its highest and some others.

    While it learns, what toxic documents hold oftener is taken from the other half of the documents, so that no document vouches for its own words.
    """
    rng = np.random.default_rng(seed)
    docs = [Words(pa.array([t], pa.string())) for t in texts]
    net = Network(log_odds(docs, labels), seed)
    halves = [log_odds(docs[1 - half :: 2], labels[1 - half :: 2]) for half in (0, 1)]
    priors = [halves[i % 2] for i in range(len(docs))]
    spans = [w.windows()[0] for w in docs]
    usable = [i for i, s in enumerate(spans) if len(s)]
    if not usable or len(set(labels[usable].tolist())) < 2:
        net.slope, net.shift = 0.0, float(np.log((class_counts or {}).get(1, 0) + 0.5) - np.log((class_counts or {}).get(0, 0) + 0.5)) if class_counts else 0.0
        return net
    step, rate = 0, 0.02
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    for epoch in range(epochs):
        chosen = []
        for i in usable:
            x = net.inputs(docs[i], priors[i])
            if epoch:
                value = net.logits(x, spans[i])
            else:
                signal = x[:, -PRIORS:].sum(1)
                value = np.array([signal[a : a + n].max() for a, n in spans[i]])
            top = np.argsort(-value, kind="stable")[: 1 if labels[i] else 2].tolist()
            if not labels[i]:
                top.append(int(rng.integers(len(value))))
            chosen += [(i, int(j)) for j in dict.fromkeys(top)]
        toxic = sum(int(labels[i]) for i, _ in chosen)
        share = len(chosen) / max(toxic, 1) / 2
        passes = max(1, LEAST_STEPS // (epochs * -(-len(chosen) // BATCH)))
        order = np.concatenate([rng.permutation(len(chosen)) for _ in range(passes)])
        for begin in range(0, len(order), BATCH):
            some = [chosen[k] for k in order[begin : begin + BATCH]]
            x = np.zeros((len(some), WINDOW, INPUTS), np.float32)
            mask = np.zeros((len(some), WINDOW), np.float32)
            for row, (i, j) in enumerate(some):
                a, n = spans[i][j]
                x[row, :n], mask[row, :n] = _inputs_of(net, docs[i], a, n, priors[i]), 1
            y = np.array([labels[i] for i, _ in some], np.float32)
            g, d_x = net.gradients(x, mask, y, np.where(y > 0, share, len(chosen) / max(len(chosen) - toxic, 1) / 2).astype(np.float32))
            step += 1
            for k, grad in g.items():
                m, v = moment[k]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad**2 - v)
                net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            for row, (i, j) in enumerate(some):  # embeddings: plain descent on what the window holds
                a, n = spans[i][j]
                np.add.at(net.word, docs[i].words[a : a + n], -rate * d_x[row, :n, :WORD_DIM])
                lo, hi = np.searchsorted(docs[i].of4, [a, a + n])
                of = docs[i].of4[lo:hi] - a
                per = np.maximum(np.bincount(of, minlength=n), 1)
                np.add.at(net.gram, docs[i].grams4[lo:hi], -rate * d_x[row, of, WORD_DIM : WORD_DIM + GRAM_DIM] / per[of][:, None])
        rate *= 0.7
    best = np.array([net.best(w, p)[0] for w, p in zip(docs, priors, strict=True)])
    weights = np.array([(class_counts or {}).get(c, 1) / max((labels == c).sum(), 1) for c in (0, 1)])[labels] if class_counts else np.ones(len(labels))
    net.slope, net.shift = _calibrated(best[usable], labels[usable], weights[usable] / weights[usable].mean())
    return net


def _inputs_of(net: Network, words: Words, a: int, n: int, priors: list[np.ndarray]) -> np.ndarray:
    """The inputs of ``n`` words from ``a`` on."""
    part = Words.__new__(Words)
    part.words, part.n = words.words[a : a + n], 1
    for grams, of in (("grams4", "of4"), ("grams5", "of5")):
        lo, hi = np.searchsorted(getattr(words, of), [a, a + n])
        setattr(part, grams, getattr(words, grams)[lo:hi])
        setattr(part, of, getattr(words, of)[lo:hi] - a)
    return net.inputs(part, priors)


def _calibrated(best: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the documents' highest scores, by damped Newton steps with a small penalty."""
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(slope * best + shift)
        wrong, curve = weights * (p - labels), np.maximum(weights * p * (1 - p), 1e-9)
        g = np.array([(wrong * best).sum() + 1e-2 * (slope - 1), wrong.sum() + 1e-2 * shift])
        h = np.array([[(curve * best**2).sum() + 1e-2, (curve * best).sum()], [(curve * best).sum(), curve.sum() + 1e-2]])
        move = np.linalg.solve(h, g)
        move *= min(1.0, 2.0 / max(np.abs(move).max(), 1e-9))
        slope, shift = slope - move[0], shift - move[1]
    return float(max(slope, 1e-3)), float(shift)


def fit_network(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Learns from at most 2 x ``per_class`` labelled rows outside the held-out fold, whose texts come to the driver."""
    sample, counts = labelled_sample(docs, labels, "toxic", per_class, id_col, text_col)
    rows = sample.toArrow()
    return train(rows["text"].to_pylist(), rows["label"].to_numpy().astype(np.int64), counts)


def with_toxicity(docs: DataFrame, network: Network, score_col: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1; every window of every text is scored, null text counts as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def work(texts):
        found, at = [], 0
        sizes = np.diff(doc_slices(texts)[1])
        while at < len(texts):  # as many texts at once as come to TEXT_SLICE, one at least
            to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), TEXT_SLICE, "right")))
            found.append(sent.value.scores(texts.slice(at, to - at)))
            at = to
        return [pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())]

    return with_columns_in_python(docs, text_col, work, [(score_col, "double")])


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted (1 from ``threshold`` on).

    Nothing but the text is scored. Null ids are not held out; ids may repeat; other columns play no part. Labels of one kind
    only, or none, give all texts the share of label 1 among them (0.5 without any); without rows there is no result.
    """
    network = fit_network(docs, labels, id_col=id_col, text_col=text_col)
    rows = docs.select(column(id_col).alias("doc_id"), is_held_out(column(id_col)).alias("held_out"), text_of(text_col).alias("text"))
    return with_toxicity(rows, network).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

