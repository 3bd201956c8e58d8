"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

P(grade >= j) = logistic(w.x - theta_j): one weight for each word, shared by all grades, and one ordered
threshold for each grade. The expected severity is the sum of P(grade >= j) over j >= 1.

The features are counts of words and of word beginnings (PREFIXES bytes, of longer words): in languages
that build words from parts a slur is often only the beginning.

The vocabulary is the features whose document counts differ most between the labelled grades 0 and above (by
likelihood ratio), counted by Spark; at most VOCABULARY of them. The regression is fitted
on the driver from at most `sample` labelled documents (default 20,000, the ones with the smallest hash of
doc_id), each as counts of vocabulary words. Everything else covers all rows and whole texts.

Grades are what the labels say: 0, 1, 2 and so on, with a threshold for each above 0. Labels that only tell toxic documents
from others, as those of the query, give one threshold, and the expected severity is then the probability of being toxic; no
finer grades are made up.

Null and empty texts have no words and get the grade that the thresholds alone give. Null labels or ids
aren't learnt from; without labels, or with labels of one kind, every severity is that of the prior.
Repeated rows are scored each; other columns are kept only where named.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cut_lineage, labelled_texts, map_texts, share, slices, table

SAMPLE = 20_000
VOCABULARY = 1024
#: Documents that a word of the vocabulary is in, at least, and its least likelihood ratio (chance gives this to one word in a thousand).
LEAST_DOCS, LEAST_RATIO = 4, 10.83
#: Features that a task counts before it hands them on.
PARTIAL = 500_000
#: Rejected from this probability of grade >= 1 on.
REJECT = 0.4

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


#: Lengths in bytes of the word beginnings that are features, written with a hyphen after them.
PREFIXES = (5, 6, 7, 8)


def words(text: str) -> list[bytes]:
    """Runs of ASCII letters and all non-ASCII characters, in lower case."""
    return text.lower().encode().translate(_LOWER).split()


def word_features(word: bytes) -> list[bytes]:
    return [word, *[word[:k] + b"-" for k in PREFIXES if len(word) > k]]


class Ordinal:
    """Weights by word, and ordered thresholds."""

    def __init__(self, vocabulary: dict[bytes, int], weights: np.ndarray, thresholds: np.ndarray):
        self.vocabulary, self.weights, self.thresholds = vocabulary, weights, thresholds
        self.heads = {w[: PREFIXES[0]].removesuffix(b"-") for w in vocabulary}

    def counts(self, text: str) -> dict[int, int]:
        found: dict[int, int] = {}
        get, heads, n = self.vocabulary.get, self.heads, PREFIXES[0]
        for w in words(text):
            if w[:n] in heads:
                for f in word_features(w):
                    if (k := get(f)) is not None:
                        found[k] = found.get(k, 0) + 1
        return found

    def at_least(self, texts: list[str]) -> np.ndarray:
        """P(grade >= j) for each text and each j from 1."""
        eta = np.zeros(len(texts))
        for i, t in enumerate(texts):
            found = self.counts(t)
            if found:
                k = np.fromiter(found.keys(), np.int64, len(found))
                eta[i] = self.weights[k] @ (1 + np.log(np.fromiter(found.values(), np.float64, len(found))))
        return 1 / (1 + np.exp(-np.clip(eta[:, None] - self.thresholds[None, :], -30, 30)))


def fit_ordinal(rows: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, n_words: int, *, steps: int = 600, penalty: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient ascent (Adam) on the likelihood of the grades.

    rows and values: word indices and feature values of each document. A threshold is the last one plus
    an exponential, so they stay ordered.
    """
    top = max(1, int(grades.max()) if len(grades) else 1)
    share_of = np.array([((grades >= j).sum() + 0.5) / (len(grades) + 1) for j in range(1, top + 1)])
    start = np.log((1 - share_of) / share_of)
    gaps = np.log(np.maximum(np.diff(start), 0.05))
    if not len(grades) or grades.min() == grades.max() or not n_words:
        return np.zeros(n_words), np.concatenate([start[:1], start[:1] + np.cumsum(np.exp(gaps))])
    size = np.array([len(r) for r in rows])
    doc, word, value = np.repeat(np.arange(len(rows)), size), np.concatenate(rows).astype(np.int64), np.concatenate(values)
    p = np.concatenate([np.zeros(n_words), start[:1], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    y = grades.astype(int)
    for step in range(1, steps + 1):
        w, theta = p[:n_words], np.concatenate([p[n_words : n_words + 1], p[n_words] + np.cumsum(np.exp(p[n_words + 1 :]))])
        eta = np.bincount(doc, w[word] * value, len(rows))
        cuts = np.concatenate([[-np.inf], theta, [np.inf]])
        above, below = 1 / (1 + np.exp(np.clip(cuts[y] - eta, -40, 40))), 1 / (1 + np.exp(np.clip(cuts[y + 1] - eta, -40, 40)))
        above[y == 0], below[y == top] = 1.0, 0.0
        prob = np.maximum(above - below, 1e-12)
        da, db = above * (1 - above) / prob, below * (1 - below) / prob
        d_eta = da - db
        g_theta = np.array([-(da[y == j]).sum() + (db[y == j - 1]).sum() for j in range(1, top + 1)])
        later = np.cumsum(g_theta[::-1])[::-1]  # a threshold moves all those after it
        g = np.concatenate([np.bincount(word, d_eta[doc] * value, n_words) - penalty * len(y) * w, later[:1], later[1:] * np.exp(p[n_words + 1 :])]) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return p[:n_words], np.concatenate([p[n_words : n_words + 1], p[n_words] + np.cumsum(np.exp(p[n_words + 1 :]))])


def telling_words(texts: DataFrame) -> list[bytes]:
    """Words of the vocabulary, from rows of text and y (0, or above: toxic)."""

    def counted(batches):
        found: dict[bytes, list[int]] = {}
        for batch in batches:
            toxic = batch.schema.get_field_index("toxic")
            for part, some in slices(batch):
                for t, y in zip(some, part.column(toxic).to_pylist(), strict=True):
                    own: set[bytes] = {b""}  # the empty word counts the documents
                    for w in set(words(t)):
                        own.update(word_features(w))
                    for f in own:
                        found.setdefault(f, [0, 0])[y] += 1
                if len(found) > PARTIAL:
                    yield rows(found)
                    found = {}
        yield rows(found)

    def rows(found: dict[bytes, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), *[pa.array([n[y] for n in found.values()], pa.int64()) for y in (1, 0)]], names=["word", "a", "b"])

    bound_batches(texts)
    each = texts.select("text", (F.col("y") > 0).cast("int").alias("toxic")).mapInArrow(counted, "word binary, a long, b long")
    by_word = each.groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter(F.col("a") + F.col("b") >= LEAST_DOCS)
    by_word = cut_lineage(by_word)
    of_class = by_word.filter(F.col("word") == F.lit(b"")).first()
    if of_class is None or not of_class.a or not of_class.b:
        return []
    n_a, n_b = of_class.a, of_class.b
    share_of = (F.col("a") + F.col("b")) / (n_a + n_b)

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    cells = term(F.col("a"), share_of * n_a) + term(n_a - F.col("a"), (1 - share_of) * n_a) + term(F.col("b"), share_of * n_b) + term(n_b - F.col("b"), (1 - share_of) * n_b)
    found = by_word.filter(F.col("word") != F.lit(b"")).select("word", (2 * cells).alias("ratio"))
    rows = found.filter(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "word").limit(VOCABULARY).collect()
    return [bytes(r.word) for r in rows]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Ordinal:
    """Model of labelled documents; labels has doc_id and the label, a grade from 0."""
    texts = cut_lineage(labelled_texts(docs, labels, label, sample))  # read twice, at most `sample` rows
    found = telling_words(texts)
    vocabulary = {w: k for k, w in enumerate(found)}
    held = share(docs.sparkSession, Ordinal(vocabulary, np.zeros(len(found)), np.zeros(1)))

    def score():
        model = held.value

        def work(some: list[str]) -> list[pa.Array]:
            counts = [model.counts(t) for t in some]
            return [pa.array([list(c) for c in counts], pa.list_(pa.int32())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))]

        return work

    rows = sorted((r.doc_id, r.y, r.k, r.n) for r in map_texts(texts, ["doc_id", "y"], "k array<int>, n array<int>", score).collect())
    y = np.array([r[1] for r in rows], np.int64)
    weights, thresholds = fit_ordinal([np.array(r[2], np.int64) for r in rows], [1 + np.log(np.array(r[3], np.float64)) for r in rows], y, len(found))
    return Ordinal(vocabulary, weights, thresholds)


def _scores(p: np.ndarray) -> list[pa.Array]:
    grade = (p >= 0.5).sum(axis=1)
    return [pa.array(p[:, 0], pa.float64()), pa.array(p.sum(axis=1), pa.float64()), pa.array(grade, pa.int32()), pa.array(p[:, 0] >= REJECT, pa.bool_())]


def score(docs: DataFrame, model: Ordinal, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, p_toxic, severity (expected grade), grade (median) and toxic (p_toxic >= REJECT)."""
    held = share(docs.sparkSession, model)

    def work():
        ordinal = held.value
        return lambda texts: _scores(ordinal.at_least(texts))

    return map_texts(docs, list(keep), "p_toxic double, severity double, grade int, toxic boolean", work)


def keep_clean(docs: DataFrame, model: Ordinal) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns, in one pass and without a join."""
    held = share(docs.sparkSession, model)

    def run(batches):
        ordinal = held.value
        for batch in batches:
            for part, texts in slices(batch):
                yield part.filter(pa.array(ordinal.at_least(texts)[:, 0] < REJECT))

    bound_batches(docs)
    plain = docs.toDF(*[c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)])  # names of any form
    return plain.mapInArrow(run, T.StructType(plain.schema.fields)).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))
