"""Removal of byte strings that an earlier document has too, by suffix arrays and longest previous factors.

Each byte covered by a string of SPAN bytes that also starts in a document with a smaller doc_id goes, the
first copy stays. Overlaps count, and strings are judged on the input.

How the suffixes are brought together. Of every SPAN bytes the GRAM-byte string with the smallest hash is
the anchor (a minimiser), so equal spans have equal anchors wherever they are. Neighbouring spans with the
same anchor form one piece of text. Documents are dealt by id into blocks of about BLOCK_BYTES:

1. Each block sends the hash of each of its anchors once to the hash's bucket. The bucket answers, with a
   bit for each, which anchors are in more than one document, and which are in very many (HOT).
2. Each block sends each distinct piece around a shared anchor once, with the smallest doc_id that has it,
   to the anchor's bucket. A bucket sorts the suffixes that start spans (a suffix array), compares neighbours
   for their common prefixes, finds for each suffix the previous and the next place in suffix order of a
   smaller doc_id, and takes the longer of the two common prefixes: the longest previous factor. Spans whose
   factor reaches SPAN are in an earlier document.
   The many different surroundings of a frequent passage would meet in one bucket: of hot anchors the single
   spans are told their first document by a hash instead. A span may be in every block, so its rows meet by groups
   of blocks first, and then the groups' smallest ones: no task holds more of its rows than the root of the number
   of blocks.
3. The answer goes back to the block, which marks, removes and hashes.

So texts move once, to their block; after that only hashes, bits, and pieces of shared text move, each at
most once for each block, however often a document of the block repeats them. No block or bucket grows with
the input: their numbers do.

Null text is empty; texts shorter than SPAN are kept. A null doc_id counts as larger than all others, and
rows with the same doc_id as one document (they don't remove from each other). Rows are kept one for one.
An empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import inspect
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, table

SPAN, GRAM = 50, 20
KEPT_OF = SPAN - GRAM + 1
#: Bytes of a piece at most.
LONGEST = SPAN + KEPT_OF - 1
#: Bytes of text in a block, and of anchors in a bucket (about).
BLOCK_BYTES, BUCKET_ANCHORS = 12 << 20, 1 << 18
#: Blocks or buckets that a task works on, one after the other, at most (about).
PER_TASK = 8
#: Blocks-and-documents that an anchor is in from which it counts as hot.
HOT = 4000
#: Starts of spans that are hashed at once.
CHUNK = 1 << 18
NO_ID = np.iinfo(np.int64).max
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_LOW = np.uint64((1 << 21) - 1)


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    """64-bit hash of each GRAM-byte string of buf."""
    n = len(buf) - GRAM + 1
    word = lambda at, kind: np.ndarray((n,), kind, buf.data, at, (1,))
    h = word(0, "<u8") * _A
    h ^= h >> np.uint64(32)
    h += word(8, "<u8") * _B
    h *= _D
    h ^= h >> np.uint64(29)
    h += word(16, "<u4") * _C
    h *= _A
    h ^= h >> np.uint64(32)
    h *= _D
    h ^= h >> np.uint64(31)
    return h


def pieces_of(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First span, last span (starts) and anchor hash of each piece of the texts in buf; ends: where each text ends."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = 0
    n = len(buf) - SPAN + 1
    # Spans that reach over the end of their text are none.
    own = np.unique(ends)  # so that at most SPAN of these stretches overlap
    edge = np.zeros(max(0, n) + 1, np.int16)
    np.add.at(edge, np.clip(own - SPAN + 1, 0, len(edge) - 1), 1)
    np.add.at(edge, np.clip(own, 0, len(edge) - 1), -1)
    over = np.cumsum(edge[:-1], dtype=np.int16) > 0
    while at < n:
        upto = min(n, at + CHUNK)
        part = buf[at : upto + SPAN - 1]
        h = _gram_hashes(part)
        key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        x, have = key, 1
        while have * 2 <= KEPT_OF:
            x = np.minimum(x[:-have], x[have:])
            have *= 2
        if have < KEPT_OF:
            x = np.minimum(x[: len(x) - (KEPT_OF - have)], x[KEPT_OF - have :])
        anchor = (x & _LOW).astype(np.int64)
        anchor[over[at:upto]] = -1
        cut = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        # Equal anchors on both sides of an end can't be: spans across it lie between.
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut, [len(anchor)]]) - 1
        real = anchor[first] >= 0
        found.append((first[real] + at, last[real] + at, h[anchor[first[real]]]))
        at = upto
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Block:
    """Texts of a block in one buffer, in doc_id order, with their pieces."""

    def __init__(self, docs: pa.Table):
        ids = docs.column("doc_id").fill_null(int(NO_ID)).to_numpy()
        self.order = np.argsort(ids, kind="stable")
        self.nulls = docs.column("doc_id").is_null().to_numpy()[self.order]
        self.ids = ids[self.order]
        texts = docs.column("text").fill_null("").cast(pa.large_string()).combine_chunks().take(pa.array(self.order))
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = texts.buffers()[2]
        self.buf = np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])) if data is not None and len(texts) else np.zeros(0, np.uint8)
        self.ends = (offsets[1:] - offsets[0]).astype(np.int64)
        self.first, self.last, self.anchor = pieces_of(self.buf, self.ends) if len(self.buf) >= SPAN else pieces_of(np.zeros(0, np.uint8), self.ends)
        self.doc = np.repeat(np.arange(len(self.ends)), np.diff(np.searchsorted(self.first, self.ends), prepend=0))
        # Distinct anchors in order; pieces in that order, and which distinct anchor each piece has.
        self.sorted = np.argsort(self.anchor, kind="stable")
        a = self.anchor[self.sorted]
        self.new = np.concatenate([np.ones(min(1, len(a)), bool), a[1:] != a[:-1]])
        self.known = a[self.new]
        self.which = np.empty(len(a), np.int64)
        self.which[self.sorted] = np.cumsum(self.new) - 1

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchor hashes in order, and in how many documents of the block each is (up to 255)."""
        d = self.ids[self.doc][self.sorted]  # pieces are in doc_id order, so equal ids are neighbours
        other = self.new | np.concatenate([np.zeros(min(1, len(d)), bool), d[1:] != d[:-1]])
        at = np.flatnonzero(self.new)
        return self.known, np.minimum(np.add.reduceat(other.astype(np.int64), at), 255).astype(np.uint8) if len(at) else np.zeros(0, np.uint8)

    def shared(self, mail: dict[int, tuple[bytes, bytes]], buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """For each piece, whether its anchor is shared, and whether it is hot, as the buckets answered."""
        several, hot = np.zeros(len(self.known), bool), np.zeros(len(self.known), bool)
        for bucket, own in by_bucket(self.known, buckets):
            bits = mail.get(bucket)
            if bits is not None:
                several[own], hot[own] = (np.unpackbits(np.frombuffer(b, np.uint8), count=len(own)).astype(bool) for b in bits)
        return several[self.which], hot[self.which]

    def pieces(self, which: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The pieces that are asked for as strings, where they start, and their numbers."""
        raw, own = self.buf.tobytes(), np.flatnonzero(which)
        return [raw[a:b] for a, b in zip(self.first[own].tolist(), (self.last[own] + SPAN).tolist(), strict=True)], self.first[own], own

    def spans(self, which: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The single spans of the pieces that are asked for, where they start, and their pieces' numbers."""
        raw, own = self.buf.tobytes(), np.flatnonzero(which)
        n = self.last[own] - self.first[own] + 1
        starts = np.repeat(self.first[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return [raw[a : a + SPAN] for a in starts.tolist()], starts, np.repeat(own, n)


def by_bucket(hashes: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """Each bucket with the places of its hashes, in the order of the hashes given."""
    if not len(hashes):
        return []
    of = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    cut = np.flatnonzero(of[order][1:] != of[order][:-1]) + 1
    return [(int(of[own[0]]), own) for own in np.split(order, cut)]


def _mail_table(rows: list[tuple]) -> pa.Table:
    kinds = {"block": pa.int64(), "bucket": pa.int64(), "kind": pa.int32(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary(), "d": pa.binary()}
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.table({k: pa.array(c, t) for (k, t), c in zip(kinds.items(), cols, strict=True)})


MAIL = "block long, bucket long, kind int, a binary, b binary, c binary, d binary"
# Kinds of mail to and from blocks.
ANCHORS, PIECES, HOT_SPANS = 1, 2, 3


def send_anchors(buckets: int):
    def run(docs: pa.Table) -> pa.Table:
        block, known = Block(docs), docs.column("block")[0].as_py()
        hashes, counts = block.anchors()
        return _mail_table([(known, bucket, ANCHORS, (hashes[own] >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), counts[own].tobytes(), None, None) for bucket, own in by_bucket(hashes, buckets)])

    return run


def answer_anchors(mail: pa.Table, hot_from: int | None = None) -> pa.Table:
    """Bits for each block's anchors: in more than one document, in very many."""
    rows = mail.to_pylist()
    size = [len(r["a"]) // 6 for r in rows]
    wide = np.zeros((sum(size), 8), np.uint8)
    wide[:, :6] = np.frombuffer(b"".join(r["a"] for r in rows), np.uint8).reshape(-1, 6)
    values, inverse = np.unique(wide.view("<u8").ravel(), return_inverse=True)
    total = np.bincount(inverse, np.frombuffer(b"".join(r["b"] for r in rows), np.uint8), len(values))
    several, hot = (total > 1)[inverse], (total >= (hot_from or HOT))[inverse]
    out, at = [], 0
    for r, n in zip(rows, size, strict=True):
        out.append((r["block"], r["bucket"], ANCHORS, np.packbits(several[at : at + n]).tobytes(), np.packbits(hot[at : at + n]).tobytes(), None, None))
        at += n
    return _mail_table(out)


def _of_kind(mail: pa.Table, kind: int) -> list[dict]:
    return mail.filter(pc.equal(mail.column("kind"), kind)).to_pylist()


def _anchor_bits(mail: pa.Table) -> dict[int, tuple[bytes, bytes]]:
    return {r["bucket"]: (r["a"], r["b"]) for r in _of_kind(mail, ANCHORS)}


def _string_hashes(strings: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, strings), np.uint64, len(strings))


def _first_of(strings: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Distinct strings and the place of the first of each: texts are in doc_id order, so it has the smallest."""
    distinct: dict[bytes, int] = {}
    for k, s in enumerate(strings):
        distinct.setdefault(s, k)
    return list(distinct), np.fromiter(distinct.values(), np.int64, len(distinct))


def send_pieces(buckets: int):
    def run(docs: pa.Table, mail: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _mail_table([])
        block, known = Block(docs), docs.column("block")[0].as_py()
        several, hot = block.shared(_anchor_bits(mail), buckets)
        pieces, _, of = block.pieces(several & ~hot)
        strings, pick = _first_of(pieces)
        anchor, doc = block.anchor[of[pick]], block.ids[block.doc[of[pick]]]
        rows = []
        for bucket, own in by_bucket(anchor, buckets):
            items = [strings[i] for i in own.tolist()]
            size = np.array([len(x) for x in items], np.uint8).tobytes()
            rows.append((known, bucket, PIECES, b"".join(items), size, doc[own].astype("<i8").tobytes(), (anchor[own] >> np.uint64(32)).astype("<u4").tobytes()))
        return _mail_table(rows)

    return run


def _span_key(span: bytes) -> bytes:
    return xxhash.xxh3_128_digest(span)


def send_spans(buckets: int):
    """For each distinct single span around a hot anchor: the block, a 128-bit hash of the span and the block's smallest document with it."""

    def run(docs: pa.Table, mail: pa.Table) -> pa.Table:
        none = pa.table({"block": pa.array([], pa.int64()), "span": pa.array([], pa.binary()), "doc": pa.array([], pa.int64())})
        bits = _anchor_bits(mail)
        if not docs.num_rows or not any(any(b) for _, b in bits.values()):
            return none
        block, known = Block(docs), docs.column("block")[0].as_py()
        spans, _, of = block.spans(block.shared(bits, buckets)[1])
        strings, pick = _first_of(spans)
        keys = [_span_key(s) for s in strings]
        return pa.table({"block": pa.array([known] * len(keys), pa.int64()), "span": pa.array(keys, pa.binary()), "doc": pa.array(block.ids[block.doc[of[pick]]])})

    return run


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that two rows of equally long byte strings have in common at their beginnings."""
    other = a != b
    return np.where(other.any(axis=1), other.argmax(axis=1), a.shape[1])


def suffix_array(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of strings (start and length in text) in order, those that are equal by docs, and the common prefix of each with the one before it (0 for the first).

    Suffixes are at most LONGEST bytes long; zero bytes after their end only break ties, as the prefixes are cut to the lengths.
    """
    padded = np.concatenate([text, np.zeros(LONGEST, np.uint8)])
    window = np.ndarray((len(text), LONGEST), np.uint8, padded.data, 0, (1, 1))
    rows = window[starts]
    for lo in range(0, len(rows), CHUNK):
        rows[lo : lo + CHUNK][np.arange(LONGEST)[None, :] >= lengths[lo : lo + CHUNK, None]] = 0
    # Big-endian words compare like their bytes: they are swapped in place, and back.
    words = rows.view(np.uint64)
    words.byteswap(inplace=True)
    order = np.lexsort((docs, lengths, *words.T[::-1]))
    words.byteswap(inplace=True)
    prefix = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), CHUNK):
        hi = min(len(order), lo + CHUNK)
        here, last = order[lo:hi], order[lo - 1 : hi - 1]
        prefix[lo:hi] = np.minimum(_common(rows[here], rows[last]), np.minimum(lengths[here], lengths[last]))
    return order, prefix


def _smaller_before(docs: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """For each place in suffix order, the common prefix with the nearest place before it that has a smaller doc (0 if there is none).

    That place is found by halving steps: `least[k]` and `shortest[k]` hold the smallest doc, and the shortest common prefix, of the
    2**k places up to each one, so a step of 2**k places is taken wherever it holds no smaller doc.
    """
    n = len(docs)
    least, shortest = [docs], [prefix]
    # Places whose common prefix is below SPAN separate stretches that need not be looked across.
    cuts = np.flatnonzero(prefix < SPAN)
    longest = int(np.diff(np.concatenate([cuts, [n]])).max()) if n else 1
    while 1 << len(least) <= longest:
        step = 1 << (len(least) - 1)
        for held in (least, shortest):
            held.append(np.concatenate([held[-1][:step], np.minimum(held[-1][step:], held[-1][:-step])]))
    at, length = np.arange(n, dtype=np.int32), np.full(n, LONGEST, np.uint8)
    # The places before `at` are looked at; `length` is the common prefix with the place `at`.
    for k in range(len(least) - 1, -1, -1):
        step = 1 << k
        go = np.flatnonzero(at >= step)
        here = at[go] - 1
        keep = least[k][here] >= docs[go]
        go = go[keep]
        length[go] = np.minimum(length[go], shortest[k][at[go]])
        at[go] -= step
    ok = at > 0
    out = np.zeros(n, np.uint8)
    before = at[ok] - 1
    reached = docs[before] < docs[ok]
    out[ok] = np.where(reached, np.minimum(length[ok], prefix[at[ok]]), 0)
    return out


def previous_factors(docs: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix, in suffix order: the longest prefix that it has in common with a suffix of a smaller doc.

    It is had in common with the previous or the next place in suffix order of a smaller doc, as all others lie beyond these.
    Factors shorter than SPAN may come out as shorter ones.
    """
    after = np.concatenate([prefix[:1], prefix[:0:-1]])  # from the end: with the place after
    ranks = np.unique(docs, return_inverse=True)[1].astype(np.int32)  # the steps hold many copies: small numbers do
    prefix, after = prefix.astype(np.uint8), after.astype(np.uint8)
    return np.maximum(_smaller_before(ranks, prefix), _smaller_before(ranks[::-1], after)[::-1])


def answer_pieces(mail: pa.Table) -> pa.Table:
    """For each string that a block asked about: the smallest document that has it, and its longest previous factors as runs of starts that are covered.

    A string that a smaller document has too is covered whole; of the smallest document's, the spans whose factor reaches SPAN are.
    """
    rows = mail.to_pylist()
    size = np.frombuffer(b"".join(r["b"] for r in rows), np.uint8).astype(np.int64)
    docs = np.frombuffer(b"".join(r["c"] for r in rows), "<i8")
    raw = b"".join(r["a"] for r in rows)
    at = np.cumsum(size) - size
    text = np.frombuffer(raw, np.uint8)
    strings = [raw[a : a + n] for a, n in zip(at.tolist(), size.tolist(), strict=True)]
    # Equal strings count once, with the smallest document.
    number: dict[bytes, int] = {}
    which = np.fromiter((number.setdefault(s, len(number)) for s in strings), np.int64, len(strings))
    first = np.full(len(number), NO_ID)
    np.minimum.at(first, which, docs)
    one = np.zeros(len(number), np.int64)
    one[which] = np.arange(len(which))
    spans = size[one] - SPAN + 1
    base = np.cumsum(spans) - spans
    starts = np.repeat(at[one] - base, spans) + np.arange(int(spans.sum()))
    lengths = np.repeat(at[one] + size[one], spans) - starts
    of = np.repeat(first, spans)
    # Equal spans have equal anchors: a string that is alone with its anchor needs no sorting.
    _, group, members = np.unique(np.frombuffer(b"".join(r["d"] for r in rows), "<u4")[one], return_inverse=True, return_counts=True)
    some = np.flatnonzero(np.repeat(members[group] > 1, spans)) if len(one) else base
    factor = np.zeros(len(of), np.uint8)
    order, prefix = suffix_array(text, starts[some], lengths[some], of[some])
    factor[some[order]] = previous_factors(of[some][order], prefix)
    earlier = factor >= SPAN
    hashes = _string_hashes(list(number))
    out, lo = [], 0
    del order, prefix, starts, lengths
    for r in rows:
        n = len(r["b"])
        own = which[lo : lo + n]
        # Of the document that the string is first in, the flags of its spans; of any other, all of them.
        mine = docs[lo : lo + n] == first[own]
        lo += n
        count = np.where(mine, spans[own], 0)
        pick = np.repeat(base[own] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        flags = np.packbits(earlier[pick]).tobytes() if len(pick) else b""
        out.append((r["block"], r["bucket"], PIECES, hashes[own].tobytes(), count.astype(np.uint8).tobytes(), flags, first[own].astype("<i8").tobytes()))
    return _mail_table(out)


def _answers(mail: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all answers to a block about pieces, by string hash in order: hash, first document and place of its flags; then all flags."""
    hashes, firsts, places, flags, n = [], [], [], [], 0
    for r in _of_kind(mail, PIECES):
        count = np.frombuffer(r["b"], np.uint8).astype(np.int64)
        hashes.append(np.frombuffer(r["a"], np.uint64))
        firsts.append(np.frombuffer(r["d"], "<i8"))
        places.append(n + np.cumsum(count) - count)
        flags.append(np.unpackbits(np.frombuffer(r["c"], np.uint8), count=int(count.sum())).view(bool))
        n += int(count.sum())
    if not hashes:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(bool)
    h = np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    return h[order], np.concatenate(firsts)[order], np.concatenate(places)[order], np.concatenate(flags)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _result(rows: list[tuple], with_text: bool) -> pa.Table:
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()} | ({"kept": pa.binary()} if with_text else {})
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.table({k: pa.array(c, t) for (k, t), c in zip(kinds.items(), cols, strict=True)})


def remove(buckets: int, with_text: bool):
    def run(docs: pa.Table, mail: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _result([], with_text)
        block = Block(docs)
        raw = block.buf.tobytes()
        edge = np.zeros(len(raw) + 1, np.int32)
        several, hot = block.shared(_anchor_bits(mail), buckets)
        pieces, starts, of = block.pieces(several & ~hot)
        if pieces:
            hashes, firsts, flag_at, flags = _answers(mail)
            at = np.searchsorted(hashes, _string_hashes(pieces))
            n = block.last[of] - block.first[of] + 1
            later = block.ids[block.doc[of]] > firsts[at]
            np.add.at(edge, starts[later], 1)
            np.add.at(edge, (starts + n + SPAN - 1)[later], -1)
            own, n = np.flatnonzero(~later), n[~later]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            covered = (np.repeat(starts[own], n) + step)[flags[np.repeat(flag_at[at[own]], n) + step]]
            np.add.at(edge, covered, 1)
            np.add.at(edge, covered + SPAN, -1)
        spans, starts, of = block.spans(hot)
        if spans:
            told = mail.filter(pc.equal(mail.column("kind"), HOT_SPANS))
            first = dict(zip(told.column("a").to_pylist(), told.column("bucket").to_pylist(), strict=True))
            del told
            firsts = np.fromiter((first[k] for k in map(_span_key, spans)), np.int64, len(spans))
            covered = starts[firsts < block.ids[block.doc[of]]]
            np.add.at(edge, covered, 1)
            np.add.at(edge, covered + SPAN, -1)
        gone = np.cumsum(edge[:-1]) > 0
        out, lo = [], 0
        for i, hi in enumerate(block.ends.tolist()):
            own = gone[lo:hi]
            n = int(own.sum())
            kept = block.buf[lo:hi][~own].tobytes() if n else raw[lo:hi]
            spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if n else 0
            row = (None if block.nulls[i] else int(block.ids[i]), hi - lo, n, spans, hashlib.sha256(kept).hexdigest())
            out.append((*row, kept) if with_text else row)
            lo = hi
        return _result(out, with_text)

    return run


def _returning(work: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """work, which hands memory back after each group, since a worker may idle while others need it. The number of tables has to stay visible to Spark."""

    def one(a: pa.Table) -> pa.Table:
        try:
            return work(a)
        finally:
            pa.default_memory_pool().release_unused()

    def two(a: pa.Table, b: pa.Table) -> pa.Table:
        try:
            return work(a, b)
        finally:
            pa.default_memory_pool().release_unused()

    return one if len(inspect.signature(work).parameters) == 1 else two


def _dealt(df: DataFrame, key: str, groups: int) -> DataFrame:
    """df dealt by key to enough partitions for PER_TASK groups each, where the session's number of partitions is too low for that."""
    least = -(-groups // PER_TASK)
    return df.repartition(least, key) if least > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def first_documents(spans: DataFrame, groups: int) -> DataFrame:
    """block, span and `first`, the smallest doc with that span, of rows block, span, doc.

    Rows of a span meet by group of blocks, whose smallest ones then meet; what a smaller one of another group changes goes
    back by group and span. So no task meets more rows of a span than a group has blocks, or than there are groups.
    """
    group = F.pmod("block", F.lit(groups))
    in_group = Window.partitionBy("group", "span").orderBy("doc")
    dealt = spans.withColumn("group", group)
    # Both branches read all columns of one exchange, which Spark so makes once; a rank would put a limit before it in one of them.
    own = dealt.withColumn("least", F.first("doc").over(in_group)).select("group", "block", "span", "least")
    leaders = dealt.withColumn("before", F.lag("doc").over(in_group)).filter("before is null").select("block", "span", "doc")
    smaller = leaders.withColumn("first", F.min("doc").over(Window.partitionBy("span"))).filter("first < doc")
    return own.join(smaller.select(group.alias("group"), "span", "first"), ["group", "span"], "left").select("block", "span", F.coalesce("first", "least").alias("first"))


def deduplicate(docs: DataFrame, *, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with_text: the remaining bytes as `kept` too; hot: documents from which an anchor counts as hot."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    buckets = max(1, -(-total * 2 // (KEPT_OF + 1) // BUCKET_ANCHORS))
    docs = docs.withColumn("block", F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(blocks)))
    bound_batches(docs)
    by_block = _dealt(docs, "block", blocks).groupBy("block")
    asked = _dealt(by_block.applyInArrow(_returning(send_anchors(buckets)), MAIL), "bucket", buckets)
    bits = asked.groupBy("bucket").applyInArrow(_returning(lambda mail: answer_anchors(mail, hot)), MAIL)
    with_bits = by_block.cogroup(bits.groupBy("block"))
    asked = with_bits.applyInArrow(_returning(send_pieces(buckets)), MAIL)
    answers = _dealt(asked, "bucket", buckets).groupBy("bucket").applyInArrow(_returning(answer_pieces), MAIL)
    # Spans around hot anchors: each block has at most one row of a span.
    spans = with_bits.applyInArrow(_returning(send_spans(buckets)), "block long not null, span binary not null, doc long not null")
    none = F.lit(None).cast("binary")
    firsts = first_documents(spans, math.isqrt(blocks - 1) + 1)
    told = firsts.select("block", F.col("first").alias("bucket"), F.lit(HOT_SPANS).alias("kind"), F.col("span").alias("a"), none.alias("b"), none.alias("c"), none.alias("d"))
    mail = bits.unionByName(answers).unionByName(told)
    return by_block.cogroup(mail.groupBy("block")).applyInArrow(_returning(remove(buckets, with_text)), RESULT + ", kept binary" * with_text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))


#: DuckDB: every window of 50 bytes, as hexadecimal text, with the first document that has it; runs of their starts are removed.
SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents
), w as (select doc_id, i, substr(h, 2 * i + 1, 100) as g from (select doc_id, h, unnest(range(0, length(h) // 2 - 49)) as i from d where length(h) >= 100)
), b as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by g) as first from w) where first < doc_id
), s as (select doc_id, i, sum(opens) over (partition by doc_id order by i) as run from (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as opens from b)
), r as (select doc_id, run, min(i) as lo, max(i) + 50 as hi from s group by doc_id, run
), k as (select doc_id, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as past from r
), n as (select doc_id, sum(hi - lo) as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * past + 1, 2 * (lo - past)), '' order by lo) || substr(any_value(h), 2 * max(hi) + 1) as kept from k join d using (doc_id) group by doc_id)
select doc_id, length(h) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join n using (doc_id)
"""
