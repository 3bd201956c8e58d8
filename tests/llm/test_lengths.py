import random

import public_tokenizers
from tokenizers import Tokenizer

from evspark.llm import lengths as L


def brute(ns):
    return {n: (ns.count(n), sum(x >= n for x in ns), sum(x for x in ns if x >= n), sum(x <= n for x in ns), sum(min(x, n) for x in ns)) for n in set(ns)}


def test_sums(spark):
    rnd = random.Random(3)
    ns = [rnd.choice([0, 1, 5, 4095, 4096, 4097, 9000, 100_000]) for _ in range(200)]
    sums = L.suffix_sums(L.histogram(spark.createDataFrame([(n,) for n in ns], "n_tokens long"))).cache()
    got = {r.n_tokens: (r.n_docs, r.docs_ge, r.tokens_ge, r.docs_le, r.truncated_tokens) for r in sums.collect()}
    assert got == brute(ns)
    for q in (0.01, 0.5, 0.9, 1.0):
        want = sorted(ns)[max(0, -(-int(q * 1000) * len(ns) // 1000) - 1)]
        assert L.quantile(sums, q).first()[0] == want
    for r in L.totals_at(sums, [0, 3, 4096, 10**6]).collect():
        assert r.n_longer == sum(x > r.context_limit for x in ns)
        assert r.truncated_tokens == sum(min(x, r.context_limit) for x in ns)


def test_groups_and_edges(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 3), (None, 3)], "g string, n_tokens long")
    got = {(r.g, r.n_tokens): (r.n_docs, r.docs_ge, r.truncated_tokens) for r in L.suffix_sums(L.histogram(df, ("g",)), ("g",)).collect()}
    assert got == {("a", 1): (1, 1, 1), ("a", 0): (1, 2, 0), (None, 3): (2, 2, 6)}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert L.suffix_sums(L.histogram(L.token_lengths(empty))).count() == 0
    assert L.totals_at(L.suffix_sums(L.histogram(L.token_lengths(empty))), [5]).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    ns = [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    got = {r.n_tokens: (r.n_docs, r.docs_ge, r.tokens_ge, r.docs_le, r.truncated_tokens) for r in L.query(spark, sf).collect()}
    assert got == brute(ns)


def test_text_beyond_a_slice(spark):
    """A text of several slices and batches between short ones is counted whole."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["short", "some more words é, " * 300_000, None, "last"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = [r.n_tokens for r in L.token_lengths(df).collect()]
    want = [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert sorted(got) == sorted(want) and max(got) > 1_000_000
