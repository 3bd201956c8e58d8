import hashlib
import random

import numpy as np

from evspark.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, block string, mail string"


def brute(rows):
    top = S.NO_ID
    first: dict[bytes, int] = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            first[w] = min(first.get(w, top), top if d is None else d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < (top if d is None else d):
                gone[i : i + 50] = [True] * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    return sorted(map(tuple, S.deduplicate(df).collect()), key=str)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    letters = "ab" if seed % 2 else "abcdefghijklmnopqrstuvwxyz é"
    make = lambda k: "".join(rnd.choice(letters) for _ in range(k))
    shared = [make(k) for k in (30, 49, 50, 51, 80, 300)]
    rows = []
    for d in range(n):
        text = "".join(rnd.choice([make(rnd.randint(0, 60)), rnd.choice(shared), rnd.choice(shared)[rnd.randint(0, 20) :]]) for _ in range(rnd.randint(0, 6)))
        rows.append((d, text))
    rows += [(n, rows[3][1]), (n + 1, None), (n + 2, ""), (None, rows[4][1] + "tail"), (None, make(70)), (7, rows[7][1]), (7, shared[5]), (n + 3, "a" * 500), (n + 4, "a" * 120), (n + 5, "\0" * 60), (n + 6, "\0" * 51)]
    rnd.shuffle(rows)
    return rows


def test_brute_force(spark):
    for seed in range(3):
        rows = corpus(seed)
        assert run(spark, rows) == brute(rows)


def test_many_blocks(spark, monkeypatch):
    rows = corpus(4, 150)
    want = brute(rows)
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    monkeypatch.setattr(S, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(S, "BUCKET_ANCHORS", 100)
    assert sorted(map(tuple, S.deduplicate(df).collect()), key=str) == want
    monkeypatch.setattr(S, "PER_TASK", 1)
    assert sorted(map(tuple, S.deduplicate(df).collect()), key=str) == want


def test_hot_path_in_process(monkeypatch):
    """The same steps without Spark, with a low HOT and small chunks, which its workers would not see."""
    import pyarrow as pa

    monkeypatch.setattr(S, "HOT", 5)
    monkeypatch.setattr(S, "CHUNK", 97)
    rows = corpus(5, 120)
    blocks, buckets = 3, 4
    parts = [pa.table({"doc_id": pa.array([d for d, _ in own], pa.int64()), "text": pa.array([t for _, t in own], pa.string()), "block": pa.array([b] * len(own), pa.int64())}) for b in range(blocks) for own in [[r for r in rows if (r[0] or 0) % blocks == b]]]
    group = lambda t, key: [t.filter(pa.compute.equal(t[key], k)) for k in t[key].unique().to_pylist()]
    mail = pa.concat_tables([S.send_anchors(buckets)(p) for p in parts])
    bits = pa.concat_tables([S.answer_anchors(g) for g in group(mail, "bucket")])
    assert any(any(r["b"]) for r in bits.to_pylist())
    to = lambda t, b: t.filter(pa.compute.equal(t["block"], b))
    asked = pa.concat_tables([S.send_pieces(buckets)(p, to(bits, b)) for b, p in enumerate(parts)])
    answers = pa.concat_tables([S.answer_pieces(g) for g in group(asked, "bucket")])
    spans = pa.concat_tables([S.send_spans(buckets)(p, to(bits, b)) for b, p in enumerate(parts)]).to_pylist()
    assert spans and asked.num_rows
    first = {}
    for r in spans:
        first[r["span"]] = min(first.get(r["span"], S.NO_ID), r["doc"])
    told = S._mail_table([(r["block"], first[r["span"]], S.HOT_SPANS, r["span"], None, None, None) for r in spans])
    both = pa.concat_tables([bits, answers, told])
    got = [tuple(r.values()) for b, p in enumerate(parts) for r in S.remove(buckets, False)(p, to(both, b)).to_pylist()]
    assert sorted(got, key=str) == brute(rows)


def test_hot_spans(spark, monkeypatch):
    """Spans around hot anchors through their tasks, over many blocks and in one."""
    rows = corpus(6, 150)
    want = brute(rows)
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    assert sorted(map(tuple, S.deduplicate(df, hot=2).collect()), key=str) == want
    monkeypatch.setattr(S, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(S, "BUCKET_ANCHORS", 300)
    assert sorted(map(tuple, S.deduplicate(df, hot=3).collect()), key=str) == want


def test_first_documents(spark):
    rnd = random.Random(7)
    rows = {(b, bytes([rnd.randint(0, 40)])): rnd.randint(0, 99) for b in range(50) for _ in range(10)} | {(b, b"everywhere"): 200 - b for b in range(50)}
    least: dict[bytes, int] = {}
    for (_, s), d in rows.items():
        least[s] = min(least.get(s, d), d)
    df = spark.createDataFrame([(b, s, d) for (b, s), d in rows.items()], "block long, span binary, doc long")
    for groups in (1, 7, 64):
        got = S.first_documents(df, groups).collect()
        assert len(got) == len(rows) and all(r["first"] == least[bytes(r["span"])] for r in got)


def test_longest_previous_factors():
    """Against brute force, on strings of few letters with long repeats and zero bytes at their ends: all factors of SPAN and more are found as they are."""
    rnd = np.random.default_rng(3)
    for seed in range(4):
        base = [bytes(rnd.integers(0, 2, 400).astype(np.uint8).repeat(rnd.integers(1, 9))) + b"\0" * 70 for _ in range(2 + seed)]
        strings = [b[k : k + n] for b in base for k in rnd.integers(0, len(base[0]) - 80, 30).tolist() for n in [int(rnd.integers(50, 81))] if len(b[k : k + n]) >= 50]
        docs_of = rnd.integers(0, 12, len(strings))
        size = np.array([len(s) for s in strings])
        at = np.cumsum(size) - size
        starts = np.concatenate([np.arange(a, a + n - 49) for a, n in zip(at, size, strict=True)])
        ends = np.repeat(at + size, size - 49)
        docs = np.repeat(docs_of, size - 49)
        text = np.frombuffer(b"".join(strings), np.uint8)
        order, prefix = S.suffix_array(text, starts, ends - starts, docs)
        got = np.empty(len(starts), np.int64)
        got[order] = S.previous_factors(docs[order], prefix)
        raw = text.tobytes()
        suffix = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        common = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        assert all(suffix[a] <= suffix[b] for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True))
        for i in range(0, len(suffix), 7):
            want = max((common(suffix[i], suffix[k]) for k in range(len(suffix)) if docs[k] < docs[i]), default=0)
            assert got[i] == want if want >= S.SPAN else got[i] < S.SPAN
    assert S.previous_factors(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def test_empty_and_text(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "x" * 60 + "y"), (2, "z" + "x" * 60)], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in S.deduplicate(df, with_text=True).collect()}
    assert got == {1: b"x" * 60 + b"y", 2: b"z"}
