import numpy as np
import pytest
from pyspark.sql import functions as F

from evspark.llm import toxicity as X


def likelihood(w, theta, rows, values, y):
    cuts = np.concatenate([[-np.inf], theta, [np.inf]])
    total = 0.0
    for r, v, g in zip(rows, values, y, strict=True):
        e = (w[r] * v).sum()
        s = lambda c: 1 / (1 + np.exp(c - e)) if np.isfinite(c) else float(c < 0)
        total += np.log(s(cuts[g]) - s(cuts[g + 1]))
    return total - 0.5 * 2e-5 * len(y) * (w**2).sum()


def test_fit_is_a_maximum():
    rnd = np.random.default_rng(0)
    rows = [rnd.choice(6, rnd.integers(0, 4), replace=False) for _ in range(400)]
    values = [np.ones(len(r)) for r in rows]
    true = np.array([3.0, 2.0, 1.0, 0.0, -1.0, -2.0])
    eta = np.array([true[r].sum() for r in rows]) + rnd.logistic(size=400)
    y = (eta > 0.5).astype(int) + (eta > 2) + (eta > 4)
    w, theta = X.fit_ordinal(rows, values, y, 6, steps=3000)
    assert (np.diff(theta) > 0).all() and (np.diff(w[:3]) < 0).all()
    best = likelihood(w, theta, rows, values, y)
    for _ in range(30):
        assert likelihood(w + rnd.normal(0, 0.02, 6), theta + rnd.normal(0, 0.02, 3), rows, values, y) < best + 1e-2


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a", "t"), (2, None, "t"), (3, "", "t"), (3, "", "t"), (None, "b " * 50000, "t")], "doc_id long, text string, toxic string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")):
        model = X.fit(docs, labels)
        got = X.score(docs, model).collect()
        assert len(got) == 5 and not any(r.toxic for r in got if labels is not none)
    assert X.keep_clean(docs, X.Ordinal({b"b": 0}, np.array([9.0]), np.array([3.0]))).count() == 4
    assert X.score(docs.limit(0), model).count() == 0


def test_severity_orders():
    m = X.Ordinal({b"bad": 0}, np.array([2.0]), np.array([1.0, 2.5]))
    p = m.at_least(["", "Bad!", "bad bad BAD bad"])
    assert (np.diff(p.sum(1)) > 0).all() and (p[:, 0] > p[:, 1]).all()
    assert X.words("It's ÉTÉ-x 9") == ["it".encode(), b"s", "été".encode(), b"x"]


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = X.score(docs, X.fit(docs, labels.filter(~fold))).join(labels.filter(fold).select("doc_id", F.col("toxic").alias("y")), "doc_id").collect()
    bad = np.mean([r.toxic for r in got if r.y])
    good = np.mean([r.toxic for r in got if not r.y])
    print(len(got), bad, good, np.mean([r.severity for r in got if r.y]))
    assert bad > 0.9 and good < 0.02


def test_graded_labels(spark):
    """With four grades in the labels there are three thresholds; severity follows the grades, by brute force from the tables of the model."""
    rnd = np.random.default_rng(1)
    words = ["awful", "nasty", "rude", "kind", "tree", "house", "river", "cloud"]
    pull = np.array([3.0, 2.0, 1.2, -1.0, 0, 0, 0, 0])
    rows, grades = [], []
    for i in range(1200):
        have = rnd.choice(8, rnd.integers(1, 6))
        eta = sum(pull[k] for k in set(have)) + rnd.logistic() * 0.3
        rows.append((i, " ".join(words[k] for k in have)))
        grades.append((i, sum(bool(eta > c) for c in (1, 2.5, 4.5))))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(grades, "doc_id long, toxic int")
    model = X.fit(docs, labels.filter("doc_id % 4 > 0"))
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in X.score(docs.filter("doc_id % 4 = 0"), model).collect()}
    for d, r in got.items():
        counts = {}
        for w in rows[d][1].split():
            for f in X.word_features(w.encode()):
                if f in model.vocabulary:
                    counts[f] = counts.get(f, 0) + 1
        eta = sum(model.weights[model.vocabulary[f]] * (1 + np.log(n)) for f, n in counts.items())
        p = [1 / (1 + np.exp(t - eta)) for t in model.thresholds]
        assert abs(r.severity - sum(p)) < 1e-9 and abs(r.p_toxic - p[0]) < 1e-9 and r.grade == sum(x >= 0.5 for x in p)
    right = {g: np.mean([got[d].grade == g for d, y in grades if d in got and y == g]) for g in range(4)}
    means = [np.mean([got[d].severity for d, y in grades if d in got and y == g]) for g in range(4)]
    print(right, means)
    assert (np.diff(means) > 0.3).all() and min(right.values()) > 0.5


def test_ids_labelled_both_ways(spark, tmp_path):
    """The whole query where ids come twice in the labels with both values: each row is scored once, alike in every run, and clear words still tell."""
    docs = [(i, ("vile slur hateful " if i % 2 else "calm kind gentle ") * 5 + f"word{i % 7}") for i in range(200)] + [(5, "calm kind gentle text"), (6, None)]
    labels = [(i, i % 2) for i in range(200)] + [(i, 1 - i % 2) for i in range(0, 200, 20)] + [(None, 1), (9, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    one, two = ([tuple(r) for r in X.query(spark, str(tmp_path)).orderBy("doc_id", "p_toxic").collect()] for _ in range(2))
    assert one == two and len(one) == len(docs)
    said = {r[0]: r[1] for r in one if r[0] not in (5, 6)}
    assert min(p for d, p in said.items() if d % 2) > 0.8 > 0.4 > max(p for d, p in said.items() if not d % 2)
