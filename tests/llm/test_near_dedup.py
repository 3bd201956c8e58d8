import random

import numpy as np
import pytest

from evspark.llm import near_dedup as N

SCHEMA = "doc_id long, text string, digest string, a string"


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), None if d is None else least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def run(spark, rows):
    got = N.near_duplicates(spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)).collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 6, 20, 100, 400]))]
        for _ in range(rnd.choice([1, 2, 12])):
            w = list(base)
            for _ in range(int(len(w) * rnd.choice([0, 0.01, 0.03, 0.06]))):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            texts.append(rnd.choice([" ", "\n", "\t "]).join(w))
    texts += [texts[0].upper(), "", " \n", None, "one", "ONE", "one two three four", "É b c d e", "é b c d e", "a b c"]
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    return rows + [(None, texts[0]), (None, None), (3, texts[5]), (3, texts[3]), (3, texts[3])]


@pytest.mark.parametrize("seed", [0, 1])
def test_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_chain(spark):
    """Each text is linked with the next only, so the smallest id is many links away; part of them only meet across parts."""
    words = [f"c{i}" for i in range(400)]
    rows = [(100 - i, " ".join(words[i * 14 : i * 14 + 130])) for i in range(15)]
    assert run(spark, rows) == brute(rows)


def test_many_cells(spark, monkeypatch):
    """Copies of very different distance from their first, compared in many small cells."""
    monkeypatch.setattr(N, "CELL", 700)
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(5000)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for d in range(1, 60):
        w = list(base)
        for k in range(rnd.choice([1, 4, 6, 8, 12])):
            w[rnd.randrange(len(w))] = f"x{d if d % 3 else d // 6}_{k}"
        rows.append((d, " ".join(w)))
    assert run(spark, rows) == brute(rows)


def test_sketch_estimates():
    rnd = np.random.default_rng(0)
    for n in (1, 3, 50, 1000):
        a = rnd.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: n - n // 7], rnd.integers(0, 2**63, n // 7).astype(np.uint64)])
        got = N.sketches(np.concatenate([np.unique(a), np.unique(b)]), np.array([len(np.unique(a)), len(np.unique(b))]), 2048)
        assert (got != np.iinfo(np.uint64).max).all()
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert (got[0] == got[1]).mean() == pytest.approx(j, abs=0.05)


def test_components(spark):
    rnd = random.Random(2)
    for n, m in ((40, 20), (60, 70)):
        links = [(bytes([rnd.randrange(n)]), bytes([rnd.randrange(n)])) for _ in range(m)] + [(bytes([100 + i]), bytes([101 + i])) for i in range(30)]
        got = {bytes(r.id): bytes(r.root) for r in N.components(spark.createDataFrame(links, "a binary, b binary")).collect()}
        root = {x: x for e in links for x in e}
        for _ in range(200):
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in links)}


def test_empty(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (3, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in N.keep_first(df).collect()) == [1, 3]


def test_keep_first_of_repeated_ids(spark):
    """One row of a group stays where its smallest id is repeated; unrelated texts under one id, and rows that are linked with nothing, stay."""
    long = [f"w{i}" for i in range(60)]
    near, other = " ".join([*long[:-1], "x"]), " ".join(f"o{i}" for i in range(20))
    rows = [(1, " ".join(long)), (1, " ".join(long)), (1, near), (2, near), (1, other), (1, other), (3, other)]
    rows += [(1, ""), (1, ""), (None, other), (None, other), (5, "q r s t u v"), (5, "q r s t u v"), (7, "k l m n o p"), (7, None)]
    docs = spark.createDataFrame([(d, t, str(i)) for i, (d, t) in enumerate(rows)], "doc_id long, text string, extra string")
    got = N.keep_first(docs)
    assert got.columns == docs.columns
    left = [(r.doc_id, r.text) for r in got.collect()]
    assert len([x for x in left if x in ((1, " ".join(long)), (1, near))]) == 1
    rest = [x for x in left if x not in ((1, " ".join(long)), (1, near))]
    assert sorted(rest, key=str) == sorted([(1, other), (1, ""), (1, ""), (None, other), (None, other), (5, "q r s t u v"), (7, "k l m n o p"), (7, None)], key=str)
