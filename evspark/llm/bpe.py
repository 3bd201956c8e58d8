"""Byte-level BPE encoding and decoding with a contiguous rank array per short word.

A word's parts lie side by side in one array and the ranks of adjacent parts in another. The smallest
rank is looked up by a scan, its right boundary is deleted, and the two neighbouring ranks are refreshed,
until no adjacent pair has a rank. Words of a batch that have the same length are worked on together, so
that each step is one numpy operation for all of them. Words longer than SHORT bytes would make the
repeated scans quadratic; they keep their boundaries in a linked list and their ranks in a heap, which
merges in the same order.

Null and empty texts have no tokens. Added tokens that occur in a text become their own ids, as the
tokenizers library does by default. Rows are kept one for one, repeated rows too; other columns of the
input are not read. The vocabulary (fixed size, about 1.5 MB) is the only thing that is broadcast.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, map_texts, share, table

#: Longest word in bytes that the rank array takes.
SHORT = 40
#: Distinct words whose ids a task remembers; then it forgets them all.
REMEMBERED = 200_000
NO_RANK = np.int32(2**31 - 1)
# Fixed value: the pre-tokenisation pattern of byte-level BPE vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_chars() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Bpe:
    """Encoder and decoder for one vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, vocabulary: bytes):
        data = json.loads(vocabulary)
        stand_in, vocab = byte_chars(), data["model"]["vocab"]
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.texts: dict[int, bytes] = {i: bytes(stand_in[c] for c in w) for w, i in vocab.items()}
        self.texts |= {i: w.encode() for w, i in added.items()}
        self.added = {w: np.uint32(i).tobytes() for w, i in added.items()}
        self.split_added = re.compile("(" + "|".join(sorted(map(re.escape, added), key=len, reverse=True)) + ")") if added else None
        self.of_byte = np.zeros(256, np.int32)
        for c, b in stand_in.items():
            self.of_byte[b] = vocab[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        key = left << 32 | right
        self.order = np.argsort(key).astype(np.int32)
        self.keys = key[self.order]
        self.pair = dict(zip(key.tolist(), range(len(merges)), strict=True))
        self.words = regex.compile(WORDS)
        self.known: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NO_RANK)

    def short(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts (words x bytes, as ids) after all merges, and how many each word has left."""
        n, width = parts.shape
        left = np.full(n, width)
        if width == 1:
            return parts, left
        rank = self.ranks(parts[:, :-1], parts[:, 1:])
        todo = np.arange(n)
        out = parts.copy()
        while len(todo):
            at = rank.argmin(axis=1)
            row = np.arange(len(todo))
            best = rank[row, at]
            go = best != NO_RANK
            if not go.all():
                out[todo[~go]] = parts[~go]
                todo, parts, rank, at, best = todo[go], parts[go], rank[go], at[go], best[go]
                row = np.arange(len(todo))
                if not len(todo):
                    break
            parts[row, at] = self.merged[best]
            later = np.arange(parts.shape[1] - 1) > at[:, None]
            parts[:, :-1] = np.where(later, parts[:, 1:], parts[:, :-1])  # deletes the boundary after `at`
            rank[:, :-1] = np.where(later[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NO_RANK
            left[todo] -= 1
            follows = at + 1 < left[todo]
            rank[row, at] = NO_RANK
            rank[row[follows], at[follows]] = self.ranks(parts[row, at][follows], parts[row, np.minimum(at + 1, width - 1)][follows])
            before = at > 0
            rank[row[before], at[before] - 1] = self.ranks(parts[row[before], at[before] - 1], parts[row[before], at[before]])
        return out, left

    def long(self, word: bytes) -> bytes:
        parts = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(parts)
        after, before, gone = [*range(1, n + 1)], [*range(-1, n - 1)], [False] * n
        pair, heap = self.pair, []

        def push(i: int) -> None:
            if (j := after[i]) < n and (r := pair.get(parts[i] << 32 | parts[j])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], gone[j], after[i] = int(self.merged[r]), True, after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([p for p, g in zip(parts, gone, strict=True) if not g], "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Remember the ids of these words."""
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            b = w.encode()
            if len(b) > SHORT:
                self.known[w] = self.long(b)
            else:
                by_length.setdefault(len(b), []).append((w, b))
        for width, own in by_length.items():
            for lo in range(0, len(own), 20_000):
                some = own[lo : lo + 20_000]
                parts = self.of_byte[np.frombuffer(b"".join(b for _, b in some), np.uint8).reshape(-1, width)]
                parts, left = self.short(parts)
                rows, ends = parts.astype("<u4").tobytes(), (left * 4).tolist()
                for k, ((w, _), end) in enumerate(zip(some, ends, strict=True)):
                    self.known[w] = rows[k * width * 4 : k * width * 4 + end]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cut: list[list[str]] = []
        for t in texts:
            if self.split_added and any(a in t for a in self.added):
                found: list[str] = []
                for k, part in enumerate(self.split_added.split(t)):
                    found += ["\0added\0" + part] if k % 2 else self.words.findall(part)
                    if k % 2:
                        self.known["\0added\0" + part] = self.added[part]
                cut.append(found)
            else:
                cut.append(self.words.findall(t))
        new: set[str] = set()
        for words in cut:
            new.update(words)
        self.learn(new.difference(self.known))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in cut]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.texts.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace")


_LOADED: dict[str, Bpe] = {}


def loaded(vocabulary: bytes) -> Bpe:
    key = hashlib.sha256(vocabulary).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Bpe(vocabulary)
    return _LOADED[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, vocabulary: str | None = None, *, keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """Columns `keep`, n_tokens and ids (little-endian unsigned 32-bit integers); with `decoded` the text made of the ids too.

    `vocabulary` is the path of a byte-level BPE file of the tokenizers library, read once by the driver.
    """
    held = share(docs.sparkSession, Path(vocabulary or default_vocabulary()).read_bytes())

    def score():
        bpe = loaded(held.value)

        def work(texts: list[str]) -> list[pa.Array]:
            ids = bpe.encode(texts)
            out = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            return [*out, pa.array([bpe.decode(x) for x in ids], pa.string())] if decoded else out

        return work

    return map_texts(docs, list(keep), "n_tokens long, ids binary" + ", decoded string" * decoded, score)


def decode(encoded: DataFrame, vocabulary: str | None = None, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and the text `decoded` of column ids; null ids decode to ''."""
    held = share(encoded.sparkSession, Path(vocabulary or default_vocabulary()).read_bytes())

    def run(batches):
        bpe = loaded(held.value)
        for b in batches:
            texts = [bpe.decode(x or b"") for x in b.column(b.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in keep] + [pa.array(texts, pa.string())], names=[*keep, "decoded"])

    from pyspark.sql import types as T

    out = T.StructType([encoded.schema[c] for c in keep] + [T.StructField("decoded", T.StringType())])
    bound_batches(encoded)
    return encoded.select(*dict.fromkeys([*keep, "ids"])).mapInArrow(run, out)


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    return encode(docs, vocabulary, decoded=True).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
