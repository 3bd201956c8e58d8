"""Quality scores from a generalised additive model with pairwise interactions.

Every feature is cut into bins. Shallow trees on one feature's bins are boosted in turn over all features,
many rounds, and each tree is added to that feature's lookup table; then the pairs of features that explain
most of what is left get two-dimensional tables in the same way. A score is the logistic function of the
sum of a document's table entries, so scoring is one lookup for each feature and pair.

The model is fitted on the driver from at most `sample` labelled rows (default 20,000, the ones with the
smallest hash of doc_id, one text for each id), with FEATURES doubles each. Everything else covers all rows. Scores depend on the
text alone. Null and empty texts have a score too. Rows with a null or other label than 0 or 1 are not
learnt from; without labels every score is 0.5, with labels of one class it is close to that class. Repeated
rows are scored each; other columns are not read.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labelled_texts, map_texts, share, table

#: Labelled rows that are learnt from at most.
SAMPLE = 20_000
#: Predicted as good from this score on.
THRESHOLD = 0.3
FEATURES = (
    "log_bytes", "upper", "digits", "symbols", "pipes", "stops", "marks", "lines", "non_ascii",
    "word_length", "distinct_words", "distinct_lines", "short_words", "brackets", "longest_word", "spaces", "repeats",
)

_KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~_=+", b"|", b".,;:", b"!?", b"\n", bytes(range(128, 256)), b"<>{}[]()/\\", b" \t\r"]
_MASKS = np.array([[c in kind for c in range(256)] for kind in _KINDS], np.float64).T


def features(texts: list[str]) -> np.ndarray:
    """One row of FEATURES for each text, of the whole text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, t in enumerate(texts):
        raw = t.encode()
        n = max(1, len(raw))
        upper, digits, symbols, pipes, stops, marks, lines, high, brackets, spaces = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _MASKS / n
        words = raw.split()
        own_lines = [x for x in raw.split(b"\n") if x]
        sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
        out[i] = (
            np.log1p(len(raw)), upper, digits, symbols, pipes, stops, marks, lines, high,
            sizes.mean(), len(set(words)) / max(1, len(words)), len(set(own_lines)) / max(1, len(own_lines)),
            (sizes <= 2).mean(), brackets, np.log1p(sizes.max()), spaces, sum(map(eq, words, words[1:])) / max(1, len(words)),
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Gam:
    """Lookup tables of features and pairs; `fit` learns them, `score` adds them up."""

    def __init__(self, bins: int = 32, rounds: int = 120, pair_rounds: int = 40, pairs: int = 6, rate: float = 0.15, leaf: float = 20.0, shrink: float = 1.0):
        self.bins, self.rounds, self.pair_rounds, self.n_pairs, self.rate, self.leaf, self.shrink = bins, rounds, pair_rounds, pairs, rate, leaf, shrink
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        self.base = 0.0
        self.rows = 0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def _cut(self, g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
        """Gain and place of the best cut of a row of bins."""
        gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
        gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
        gain = gl**2 / (hl + self.shrink) + gr**2 / (hr + self.shrink)
        least = min(self.leaf, max(4.0, self.rows / 60))  # fewer rows allow smaller leaves
        gain[(nl < least) | (nr < least)] = -1
        at = int(gain.argmax()) if len(gain) else 0
        return (float(gain[at]) if len(gain) else -1.0), at + 1

    def _tree(self, g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = 3) -> np.ndarray:
        """Step for each bin: a tree of a few leaves on one feature's sums of gradients."""
        parts = [(0, len(g))]
        while len(parts) < leaves:
            best = max(((self._cut(g[a:b], h[a:b], n[a:b]), a, b) for a, b in parts if b - a > 1), default=None, key=lambda c: c[0][0] - g[c[1] : c[2]].sum() ** 2 / (h[c[1] : c[2]].sum() + self.shrink))
            if best is None or best[0][0] < 0:
                break
            (_, cut), a, b = best
            parts.remove((a, b))
            parts += [(a, a + cut), (a + cut, b)]
        step = np.zeros(len(g))
        for a, b in parts:
            step[a:b] = g[a:b].sum() / (h[a:b].sum() + self.shrink)
        return step

    def _pair_tree(self, g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
        """Gain and step of a tree that cuts the first feature once and each side of it on the second."""
        best, step = -1.0, np.zeros_like(g)
        for cut in range(1, len(g)):
            made, gain = np.zeros_like(g), 0.0
            for rows in (slice(0, cut), slice(cut, None)):
                gs, hs, ns = g[rows].sum(0), h[rows].sum(0), n[rows].sum(0)
                won, at = self._cut(gs, hs, ns)
                halves = (slice(0, at), slice(at, None)) if won >= 0 else (slice(None),)
                gain += won if won >= 0 else gs.sum() ** 2 / (hs.sum() + self.shrink)
                for cols in halves:
                    made[rows, cols] = gs[cols].sum() / (hs[cols].sum() + self.shrink)
            if gain > best:
                best, step = gain, made
        return best, step

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        if not len(y):
            return self
        self.rows = len(y)
        p = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(p / (1 - p)))
        if y.min() == y.max():
            return self
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        b = self.binned(x)
        sizes = [len(e) + 1 for e in self.edges]
        counts = [np.bincount(b[:, f], minlength=s) for f, s in enumerate(sizes)]
        self.tables = [np.zeros(s) for s in sizes]
        total = np.full(len(y), self.base)
        for _ in range(self.rounds):
            for f, s in enumerate(sizes):
                q = _sigmoid(total)
                step = self.rate * self._tree(np.bincount(b[:, f], y - q, s), np.bincount(b[:, f], q * (1 - q), s), counts[f])
                self.tables[f] += step
                total += step[b[:, f]]
        coarse = [np.arange(s) * min(8, s) // s for s in sizes]

        def sums(i: int, j: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            shape = (coarse[i][-1] + 1, coarse[j][-1] + 1)
            at = coarse[i][b[:, i]] * shape[1] + coarse[j][b[:, j]]
            return tuple(np.bincount(at, w, shape[0] * shape[1]).reshape(shape) for w in (y - q, q * (1 - q), np.ones(len(y))))

        q = _sigmoid(total)
        gains = {(i, j): self._pair_tree(*sums(i, j, q))[0] for i in range(len(sizes)) for j in range(i + 1, len(sizes))}
        self.pairs = sorted(gains, key=gains.get, reverse=True)[: self.n_pairs]
        self.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in self.pairs]
        for _ in range(self.pair_rounds):
            for k, (i, j) in enumerate(self.pairs):
                step = self.rate * self._pair_tree(*sums(i, j, _sigmoid(total)))[1][np.ix_(coarse[i], coarse[j])]
                self.pair_tables[k] += step
                total += step[b[:, i], b[:, j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        total = np.full(len(x), self.base)
        for f, t in enumerate(self.tables):
            total += t[b[:, f]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[b[:, i], b[:, j]]
        return _sigmoid(total)


def with_features(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    def score():
        return lambda texts: [pa.array(list(features(texts)), pa.list_(pa.float64()))]

    return map_texts(docs, list(keep), "features array<double>", score)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Gam:
    """Model of the labelled documents; labels has doc_id and the label column."""
    texts = labelled_texts(docs, labels.filter(F.col(label).isin(0, 1)), label, sample)
    rows = sorted((r.doc_id, r.y, r.features) for r in with_features(texts, ("doc_id", "y")).collect())
    return Gam().fit(np.array([r[2] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r[1] for r in rows], np.float64))


def score(docs: DataFrame, model: Gam, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and score, from 0 to 1."""
    held = share(docs.sparkSession, model)

    def work():
        gam = held.value
        return lambda texts: [pa.array(gam.score(features(texts)), pa.float64())]

    return map_texts(docs, list(keep), "score double", work)


def held_out():
    """A fifth of the documents by id, never learnt from."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return score(docs, model).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
