import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from evspark.llm import sharding as S

SCHEMA = "doc_id long, text string, `a.b` string, Key string, shard string"


def brute(rows, n):
    """(doc_id, size, crc, shard, slot) by one sorted list; rows that are equal may change places."""
    data = [(hashlib.md5((t or "").encode()).digest()[:8], d is not None, d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), d) for d, t in rows]
    total, before, slots, out = sum(x[3] for x in data), 0, defaultdict(int), []
    for x in sorted(data, key=lambda x: x[:3]):
        shard = min(n - 1, (2 * before + x[3]) * n // (2 * total))
        out.append((x[5], x[3], x[4], shard, slots[shard]))
        slots[shard] += 1
        before += x[3]
    return sorted(out, key=repr)


def made(kind):
    rnd = random.Random(5)
    if kind == "mixed":
        rows = [(i, "".join(rnd.choices("aé日 ", k=rnd.randrange(60)))) for i in range(300)]
        return [*rows, (None, None), (None, "x"), (-7, ""), (2**63 - 1, "x"), (-(2**63), "y"), (5, rows[5][1]), (5, rows[5][1])]
    if kind == "copies":  # half the bytes are one text, and a third of the rows are empty
        return [*((i, "the same text of many records") for i in range(300)), *((1000 + i, None) for i in range(200)), *((2000 + i, f"own {i}") for i in range(100))]
    if kind == "repeats":  # rows that are equal in all
        return [(1, "again and again")] * 400 + [(2, "once")]
    return [(1, "a" * 1_000_000), (2, "b"), (3, "c" * 400_000)] if kind == "long" else [(9, "one")]


@pytest.mark.parametrize("kind", ["mixed", "copies", "repeats", "long", "one"])
@pytest.mark.parametrize("n,ranges", [(24, None), (5, 300)])
def test_as_brute_force(spark, kind, n, ranges):
    rows = made(kind)
    got = S.placed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n, ranges).collect()
    assert sorted([(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got], key=repr) == brute(rows, n)


def test_law(spark):
    rows = made("mixed") + made("copies")
    got = S.placed(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    longest = max(r["size"] for r in got)
    mean = sum(sizes.values()) / 24
    assert set(sizes) == set(range(24)) and all(abs(s - mean) <= longest for s in sizes.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_columns_and_no_rows(spark):
    rows = [(d, t, "p", "k", str(i)) for i, (d, t) in enumerate(made("mixed"))]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = S.cuts(docs, 6)(docs)
    assert got.columns == [*docs.columns, "_shard"]
    where = sorted([(r.doc_id, len((r.text or "").encode()) + 8, r._shard) for r in got.collect()], key=repr)
    assert where == sorted([(r[0], r[1], r[3]) for r in brute([x[:2] for x in rows], 6)], key=repr)
    none = docs.limit(0)
    assert S.placed(none).columns == ["doc_id", "size", "text_crc32", "key", "shard", "slot"] and S.placed(none).count() == 0
    assert S.cuts(none)(none).count() == 0
