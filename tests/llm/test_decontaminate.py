import hashlib
import random
import re

import duckdb

from evspark.llm import decontaminate as D

DOCS = "doc_id long, text string, words string, item string"


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(docs, items):
    out = []
    wins = []
    for i, t in items:
        w = words(t)
        m = min(10, len(w))
        wins += [("" if i is None else str(i), tuple(w[k : k + m])) for k in range(len(w) - m + 1) if m]
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, g in wins:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    found.add(i)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items):
    spark.createDataFrame([(d, t, "x", "y") for d, t in docs], DOCS).createOrReplaceTempView("d")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(spark.table("d"), b)
    rows = [(r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0) for r in got.collect()]
    assert D.drop_contaminated(spark.table("d"), b).count() == sum(not r[-1] for r in rows)
    return sorted(rows, key=str)


def test_random(spark):
    rnd = random.Random(7)
    for seed in range(3):
        vocab = [*"abcdefg", "É", "日本", "x9", "IT"][: 4 + 3 * seed]
        make = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choice(vocab) for _ in range(n))  # noqa: E731,B023
        items = [(i, make(rnd.choice([0, 1, 4, 7, 9, 10, 11, 15, 30]))) for i in range(8 if seed else 3)] + [(None, make(12)), (3, make(10)), (2, None)]
        docs = [(i, make(rnd.choice([0, 1, 5, 9, 10, 12, 40, 200]))) for i in range(40)]
        docs += [(90 + i, make(15) + " " + (t or "") + "." + make(20)) for i, t in items if i is not None] + [(5, "again"), (5, docs[5][1]), (5, docs[5][1]), (None, docs[6][1]), (None, None), (7, None)]
        assert run(spark, docs, items) == brute(docs, items)


def test_guarantee_at_exactly_ten_words(spark):
    rnd = random.Random(1)
    item = [f"w{i}" for i in range(60)]
    docs = [(k, " ".join([f"a{rnd.random()}"] * 5 + item[k : k + n] + [f"b{rnd.random()}"] * 5)) for k in range(50) for n in (9, 10)]
    items = [(1, " ".join(item))]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty(spark):
    some = [(1, "a b c"), (2, None)]
    assert run(spark, [], [(1, "a b c d e f g h i j")]) == []
    assert run(spark, some, []) == brute(some, [])
    assert run(spark, some, [(1, "A b")]) == brute(some, [(1, "A b")])


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = sorted(map(tuple, D.query(spark, sf).collect()))
    assert got == sorted(con.execute(D.SQL).fetchall())
    assert any(r[-1] for r in got)
