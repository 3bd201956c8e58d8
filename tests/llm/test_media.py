import hashlib
import io
import zlib

import numpy as np
import pytest

from evspark.llm import media

R = np.random.default_rng(5)


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (7, 64), (4, 6, 3), (5, 3, 3)])
def test_forms(shape):
    x = R.integers(0, 256, shape, np.uint8)
    for write in (media.write_pnm, media.write_bmp):
        assert (media.read_image(write(x)) == x).all()


def test_plain_netpbm():
    assert media.read_image(b"P2\n# made\n2 2\n255\n1 2\n3 4\n").tolist() == [[1, 2], [3, 4]]
    assert media.read_image(b"P1 3 1\n1 0 1\n").tolist() == [[0, 255, 0]]
    assert media.read_image(b"P4 3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.read_image(b"P3 1 1 255\n9 8 7\n").tolist() == [[[9, 8, 7]]]
    for bad in (b"", b"P9", b"BM"):
        with pytest.raises(Exception):
            media.read_image(bad)


@pytest.mark.parametrize(("h", "w", "a", "b"), [(8, 9, 8, 9), (16, 18, 8, 9), (1, 64, 8, 9), (5, 7, 3, 2), (3, 3, 16, 16)])
def test_resize(h, w, a, b):
    x = R.integers(0, 256, (h, w)).astype(float)
    fine = np.repeat(np.repeat(x, a, 0), b, 1)  # brute force: every source pixel as a x b equal ones
    want = fine.reshape(a, h, b, w).mean((1, 3))
    assert np.allclose(media.resize(x, a, b), want)


def test_large_images_in_strips(monkeypatch):
    """Strips give the same averages as the whole, and take far less memory than doubles of all samples."""
    import tracemalloc

    x = R.integers(0, 256, (5000, 64), np.uint8)
    want = np.add.reduceat(x.astype(float), np.arange(0, 5000, 625), axis=0) / 625
    for strip in (64, 1000, 1 << 18):
        monkeypatch.setattr(media, "STRIP", strip)
        assert np.allclose(media.resize(x, 8, 64), want)
    big = np.zeros((1 << 18, 64), np.uint8)
    tracemalloc.start()
    media.difference_hash(big)
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("shape", [(1, 64), (7, 64), (16, 64), (100, 64), (5000, 64), (9, 5, 3)])
def test_tile_and_hash_at_once(shape):
    x = R.integers(0, 256, shape, np.uint8)
    for side in (8, 12, 16, 24):
        assert media.tile_and_hash(x, side) == (media.tile(x, side), media.difference_hash(x))


def test_long_text_and_empty_tables(spark):
    """A text beyond a slice, a batch and a strip comes back whole between short ones; empty tables give empty ones."""
    texts = ["a", "word é " * 900_000, None, "z" * 65]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in media.inspect(media.store(df)).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        p = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        image = np.frombuffer(p, np.uint8).reshape(-1, 64)
        assert got[i].payload == p and got[i].n_bytes == len(b) and (bytes(got[i].tile), got[i].dhash) == media.tile_and_hash(image)
    assert media.inspect(media.store(df.limit(0))).count() == 0
    assert media.inspect(spark.createDataFrame([], "doc_id long, n_bytes long, media binary")).count() == 0


def test_query(spark):
    rows = [(1, "abc", "k"), (2, None, "k"), (3, "", "k"), (4, "é" * 500, "k"), (5, "x" * 64, "k"), (6, "abc", "k"), (None, "a\0", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = media.inspect(media.store(df)).collect()
    assert len(got) == len(rows)
    for (d, t, _), r in zip(rows, got, strict=True):
        b = (t or "").encode()
        p = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        assert (r.doc_id, r.n_bytes, r.payload, r.tail_crc32) == (d, len(b), p, zlib.crc32(p[-64:]))
        assert np.load(io.BytesIO(r.tile)).shape == (16, 16) and len(r.dhash) == 16
    assert got[0].dhash == got[5].dhash and got[0].media == got[5].media
    assert media.inspect(media.store(df, form="bmp")).collect()[3].payload == got[3].payload
    assert hashlib.sha256(got[0].payload).hexdigest()
    bad = media.inspect(spark.createDataFrame([(1, b"no"), (2, None)], "doc_id long, media binary"), keep=("doc_id",)).collect()
    assert [r.width for r in bad] == [None, None]
    assert media.store(spark.createDataFrame([], "doc_id long, text string")).count() == 0
