import hashlib
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as C
from evspark.llm import secrets, toxicity

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id: r for r in docs.collect()})
        if name != "bpe":
            assert docs.columns == columns
    source = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    toxic, near, clean, masked, encoded = kept

    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    p = model.at_least([r.text for r in source.values()])[:, 0]
    assert set(toxic) == {d for d, x in zip(source, p, strict=True) if x < toxicity.REJECT}
    assert all(toxic[d] == source[d] for d in toxic)

    sets = {d: shingle_set(r.text) for d, r in toxic.items()}
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * (both := len(sets[a] & sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root[a], root[b]
                root = {d: min(x, y) if r in (x, y) else r for d, r in root.items()}
    assert set(near) == {d for d, r in root.items() if d == r} and len(near) < len(toxic)

    grams = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        grams |= {tuple(w[i : i + min(10, len(w))]) for i in range(len(w) - min(10, len(w)) + 1) if w}
    sizes = {len(g) for g in grams}
    hit = {d for d, r in near.items() for n in sizes for i in range(len(words(r.text)) - n + 1) if tuple(words(r.text)[i : i + n]) in grams}
    assert set(clean) == set(near) - hit and hit

    assert set(masked) == set(clean)
    before = spark.createDataFrame(list(clean.values()), spark.read.parquet(f"{SF}/documents.parquet").schema)
    found = {}
    for r in secrets.findings(before, secrets.fit_for(secrets.candidates(before))).filter("secret").collect():
        found.setdefault(r.doc_id, set()).add((r.start - 1, r.length))
    for d, r in clean.items():
        text, at = "", 0
        for start, n in sorted(found.get(d, ())):
            text, at = text + r.text[at:start] + "[SECRET]", start + n
        assert masked[d].text == (text + r.text[at:] if found.get(d) else r.text)

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(encoded) == set(masked)
    for d, r in masked.items():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert encoded[d].n_tokens == len(ids) and encoded[d].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert sorted(map(tuple, C.run(spark, SF).collect())) == sorted(map(tuple, encoded.values()))
