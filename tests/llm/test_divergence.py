import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evspark.llm import divergence as D
from evspark.llm.common import if_small

WORDS = ["ab", "Ab", "straße", "日本", "x", "the", "of", "ÀÉ", "q", "zz"]


def brute(rows, least, most):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    docs, n = defaultdict(Counter), defaultdict(Counter)
    groups = sorted({(lang or "", source or "") for lang, source, _ in rows})
    for lang, source, text in rows:
        n[lang or "", source or ""].update(terms(text))
        docs[lang or ""].update(set(terms(text)))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, k in docs[lang].items() if k >= least]
        own = [g for g in groups if g[0] == lang]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p = {g: share(n[g]) for g in own}
        q = share(sum((n[g] for g in own), Counter()))
        for g in own:
            found = {"pair": [(sum(abs(p[g][t] - p[h][t]) for t in kept), h[1]) for h in own if h != g], "term": [(p[g][t] - q[t], t) for t in kept if n[g][t] and p[g][t] > q[t]]}
            for part, values in found.items():
                for i, (v, item) in enumerate(sorted(values, key=lambda x: (-x[0], x[1].encode()))):
                    if part == "pair" or i < most:
                        out.append((lang, g[1], part, item, v, i + 1))
    return sorted(out)


def made(n, seed):
    rnd = random.Random(seed)
    return [(rnd.choice(["en", "de", None, ""]), rnd.choice(["a", "b", "ç", None]), rnd.choice([None, "", "..."]) if rnd.random() < 0.1 else " ".join(rnd.choices(WORDS, k=rnd.randrange(12)))) for _ in range(n)]


@pytest.mark.parametrize("n,least,seed", [(400, 30, 1), (60, 3, 2), (40, 1, 3), (5, 30, 4)])
def test_as_brute_force(spark, n, least, seed, monkeypatch):
    rows = made(n, seed)
    docs = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], "lang string, source string, text string, term string, `a.b` int").repartition(3)
    got = D.audited(docs, least, 4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least, 4)


def test_edges(spark):
    schema = "lang string, source string, text string"
    assert D.audited(spark.createDataFrame([], schema)).count() == 0
    # One source alone, and a language without kept words.
    rows = [("en", "only", "a b")] * 30 + [("de", "x", "rare"), ("de", "y", None)]
    assert sorted(map(tuple, D.audited(spark.createDataFrame(rows, schema)).collect())) == brute(rows, 30, 50)
    # A text that is split in pieces counts as one document, and no word is cut.
    long = "word " * 600_000 + "é" * 1_500_000
    got = {r.term: (r.n, r.n_docs) for r in D.term_counts(spark.createDataFrame([("en", "s", long)], schema)).collect()}
    assert got == {None: (0, 0), "word": (600_000, 1), "é" * 1_500_000: (1, 1)}


def test_partial_counts_are_handed_on(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(D, "HELD", 3)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 9, "source": ["a", "b", "c"] * 3, "text": ["p q r", "q", "q q s"] * 3})
    found = list(D._counted([batch]))
    total = Counter()
    for b in found:
        for r in b.to_pylist():
            total[r["source"], r["term"]] += r["n"]
    assert len(found) > 2 and total["c", "q"] == 6 and total["a", "r"] == 3


def test_pairs_in_small_steps(spark, monkeypatch):
    """Vectors whose pairs don't fit a step, and sums that are handed on early."""
    import pyarrow as pa

    rnd = np.random.default_rng(1)
    rows = [{"m": int(rnd.integers(1, 5)), "entries": [{"g": int(g), "p": int(rnd.integers(50)), "zero": int(z)} for g, z in zip(rnd.permutation(12)[:k], rnd.integers(9, size=k), strict=True)]} for k in (2, 12, 5, 1, 7)]
    kind = pa.schema([("m", pa.int64()), ("entries", pa.list_(pa.struct([("g", pa.int64()), ("p", pa.int64()), ("zero", pa.int64())])))])
    want = Counter()
    for r in rows:
        for i, x in enumerate(r["entries"]):
            for y in r["entries"][i + 1 :]:
                want[min(x["g"], y["g"]), max(x["g"], y["g"])] += r["m"] * (abs(x["p"] - y["p"]) - abs(x["p"] - y["zero"]) - abs(x["zero"] - y["p"]) + abs(x["zero"] - y["zero"]))
    for step in (4, 1 << 20):
        monkeypatch.setattr(D, "PAIRS", step)
        got = Counter()
        for b in D._shared([pa.RecordBatch.from_pylist(rows, kind)]):
            for r in b.to_pylist():
                got[r["a"], r["b"]] += r["value"]
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_large_counts_are_exact(spark):
    n, total = 9 * 10**14 + 7, 4 * 10**15 + 3
    df = spark.createDataFrame([(n, total)], "n long, t long")
    assert df.select(D._share(F.col("n"), F.col("t"))).first()[0] == 1 + 10**9 * (n + 5) // total


def test_equal_vectors_are_one_row(spark):
    rows = [("en", s, "one two three") for s in "ab"] * 20 + [("en", "a", "one")] * 5
    terms = D.vectors(D.term_counts(spark.createDataFrame(rows, "lang string, source string, text string")))
    assert terms.groupBy("lang", "counts").count().count() == 2 and terms.count() == 3


def test_tables_are_broadcast_by_bytes(spark):
    df = spark.createDataFrame([(1, "x" * 1000), (2, None)], "a long, b string")
    held = lambda d: "Hint" in d._jdf.queryExecution().logical().toString()
    assert held(if_small(df)) and not held(if_small(df, 1000))
