import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evspark.llm import hard_negatives as H

SCHEMA = "vec_id long, label long, vector array<double>"


def brute(rows, every, positives=5, negatives=10):
    live = [(i, label, np.array([int(x) for x in v])) for i, label, v in rows if None not in (i, label, v) and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for *_, v in live), default=0)
    live = [(i, label, np.r_[v, np.zeros(width - len(v), int)].astype(int)) for i, label, v in live]
    out = []
    for a, label, q in live:
        if a % every:
            continue
        near = sorted((-int(q @ v), i, lab) for i, lab, v in live if i != a)
        for s, p, _ in [x for x in near if x[2] == label][:positives]:
            fit = [(-t, i) for t, i, lab in near if lab != label and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(a, p, k + 1, i, -s, t) for k, (t, i) in enumerate(fit)]
    return sorted(out)


def made(kind, n=300):
    rnd = random.Random(7)
    point = lambda spread=20: [float(rnd.randint(-spread, spread)) for _ in range(6)]
    if kind == "clusters":
        centres = [point(200) for _ in range(12)]
        return [(i, rnd.randrange(3), [x + rnd.randint(-9, 9) for x in rnd.choice(centres)]) for i in range(n)]
    if kind == "copies":  # a third of all rows is one vector
        return [(i, rnd.randrange(3), [9.0, -3.0, 40.0, 1.0, 0.0, 2.0] if i % 3 == 0 else point(30)) for i in range(n)]
    if kind == "odd":
        rows = [(i, rnd.randrange(2), point(3)) for i in range(40)]  # many ties
        rows += [(41, 1, [1.0, 2.0]), (42, 0, []), (43, None, point()), (44, 1, None), (None, 1, point()), (45, 0, [1.0, None]), (46, 0, [float("nan")] * 6), (47, 0, [float("inf")] * 6)]
        return [*rows, rows[0], rows[7], (rows[3][0], 1 - rows[3][1], point())]
    return [(i, rnd.randrange(10), point()) for i in range(n)]


@pytest.mark.parametrize("kind", ["clusters", "copies", "odd", "random"])
def test_as_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(H, "CELL_BYTES", 12 * 16)  # cells of 16 rows: many rings, and parts where keys are equal
    monkeypatch.setattr(H, "PIVOTS", 4)
    rows = made(kind)
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], SCHEMA + ", `a.b` string, Key double").repartition(3)
    got = H.mined(df, F.col("vec_id") % 5 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 5)


def test_no_rows(spark):
    assert H.mined(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    rows = [(1, 0, [1.0]), (2, 1, [2.0])]
    assert H.mined(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") > 9).count() == 0  # no anchors
    assert H.mined(spark.createDataFrame(rows, SCHEMA), F.lit(True)).count() == 0  # no positives
    assert H.mined(spark.createDataFrame([(1, 0, []), (2, 0, []), (3, 1, [])], SCHEMA), F.lit(True)).count() == 2  # all products are 0


def test_large_components_are_refused(spark):
    with pytest.raises(ValueError):
        H.mined(spark.createDataFrame([(1, 0, [1e9])], SCHEMA), F.lit(True))
    rows = [(i, i % 2, [float(i * 40_000), 3.0]) for i in range(1, 30)]  # wider numbers are stored
    assert sorted(map(tuple, H.mined(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0).collect())) == brute(rows, 5)


def test_scans_end_early(monkeypatch):
    """In clustered rows sorted by distance, blocks beyond the bound aren't multiplied."""
    rng = np.random.default_rng(3)
    x = np.r_[rng.integers(-5, 5, (500, 4)) + 100, rng.integers(-5, 5, (500, 4)) - 100].astype(float)
    space = H.Space(4, "<i2", float((x * x).sum(axis=1).max()))
    space.pivots = space.augmented(np.array([[100.0] * 4]))
    key = space.from_pivots(space.augmented(x))[:, 0]
    order = np.argsort(key)
    cell = {"key": key[order], "id": np.arange(1000)[order], "label": np.zeros(1000, int), "x": x[order]}
    asks = {"id": np.array([-1]), "label": np.array([0]), "x": x[:1], "least": np.array([[-1e9]]), "top": np.array([[1e9]])}
    monkeypatch.setattr(H, "BLOCK", 50)
    seen = []
    partition = np.partition
    monkeypatch.setattr(np, "partition", lambda a, *k, **kw: seen.append(a.shape) or partition(a, *k, **kw))
    _, score, ids = H.scan(space, cell, asks, 0, True, 5)
    want = sorted((-s, i) for i, s in enumerate(x @ x[0]))[:5]
    assert list(zip(-score, ids, strict=True)) == want and len(seen) <= 10
