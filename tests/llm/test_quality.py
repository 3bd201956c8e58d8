import numpy as np
import pytest

from evspark.llm import quality as Q


def test_interaction_is_learnt():
    rnd = np.random.default_rng(1)
    x = rnd.random((4000, 5))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)  # no single feature tells anything
    m = Q.Gam(rounds=20, pair_rounds=60).fit(x[:3000], y[:3000])
    assert (1, 3) in m.pairs
    assert ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_score_is_the_sum_of_tables():
    rnd = np.random.default_rng(2)
    x = rnd.random((500, 4))
    m = Q.Gam(rounds=10, pair_rounds=5).fit(x, (x[:, 0] > 0.3).astype(float))
    b = m.binned(x)
    for i in range(20):
        total = m.base + sum(t[b[i, f]] for f, t in enumerate(m.tables)) + sum(t[b[i, p], b[i, q]] for (p, q), t in zip(m.pairs, m.pair_tables, strict=True))
        assert m.score(x[i : i + 1])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_edges(spark):
    docs = spark.createDataFrame([(1, "good text", "q"), (2, None, "q"), (3, "", "q"), (3, "", "q"), (None, "x" * 10000, "q")], "doc_id long, text string, features string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in Q.score(docs, Q.fit(docs, none)).collect()] == [0.5] * 5
    one = spark.createDataFrame([(1, 1), (2, None), (None, 1), (3, 1)], "doc_id long, quality int")
    got = Q.score(docs, Q.fit(docs, one)).collect()
    assert len(got) == 5 and all(r.score > 0.7 for r in got)
    assert Q.score(docs.limit(0), Q.Gam()).count() == 0


def test_text_beyond_a_slice(spark):
    """A text of several slices between short ones gets the score that its features give, and all rows stay."""
    docs = spark.createDataFrame([(1, "good text."), (2, "Some words of it. " * 200_000), (3, None), (4, "bad bad bad")], "doc_id long, text string").coalesce(1)
    model = Q.fit(docs, spark.createDataFrame([(1, 1), (2, 1), (4, 0), (3, 0)], "doc_id long, quality int"))
    got = {r.doc_id: r.score for r in Q.score(docs, model).collect()}
    want = model.score(Q.features([r.text or "" for r in docs.orderBy("doc_id").collect()]))
    assert list(got) == [1, 2, 3, 4] and np.allclose([got[k] for k in (1, 2, 3, 4)], want)


def test_ids_labelled_both_ways(spark, tmp_path):
    """The whole query where ids come twice in the labels with both values, in the documents with two texts: both labels are learnt, once each."""
    words = [" ".join(f"word{(i * 7 + k) % 50}" for k in range(20)) + "." for i in range(60)]
    docs = [(i, t) for i, t in enumerate(words)] + [(5, "another text of five"), (5, words[5])]
    labels = [(i, i % 2) for i in range(60)] + [(i, 1 - i % 2) for i in range(0, 60, 3)] + [(0, 0), (None, 1), (7, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    one, two = ([tuple(r) for r in Q.query(spark, str(tmp_path)).orderBy("doc_id", "score").collect()] for _ in range(2))
    assert one == two and len(one) == len(docs) and all(0 <= r[2] <= 1 for r in one)
    twice = Q.labelled_texts(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), "quality", 1000)
    assert sorted((r.doc_id, r.y) for r in twice.collect()) == sorted({x for x in labels if None not in x})


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in Q.query(spark, sf).collect()]
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    own = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good = [p for y, p in own if y == 1]
    bad = [p for y, p in own if y == 0]
    print(len(good), np.mean(good), len(bad), np.mean(bad))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1
