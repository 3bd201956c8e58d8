"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set is its distinct shingles of five words. Sketches have SIZE coordinates, filled in rounds:
in round i < SIZE every element is hashed to a bin and a value in [i, i + 1), and a bin keeps its smallest
value; in the rounds after that every element goes to bin i - SIZE, so that every coordinate is filled at
last. Rounds stop for a document when its bins are full, usually after two. Two coordinates agree with a
probability equal to the Jaccard similarity, with concentration as for independent ones.

Equal sets are one node. BANDS bands of ROWS coordinates put nodes into buckets; two nodes of similarity
0.75 share none with a probability of 3e-7. In each bucket all nodes are compared, by their full sets, with
its centre only, the one of smallest doc_id. Where the components of these links leave the nodes around a
centre in several parts, pairs across the parts are compared too: inside tasks, by full sets, each node
outside the largest part with all others, and only links that join parts leave the task. So a group of
thousands of copies costs one comparison each, no pairs are emitted, and no link that joins components is
lost. Nodes around one centre are cut into cells of bounded size; those outside its largest part go to
every cell that they have to be compared in.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A to Z; a text of one to four words has one shingle, one
without words has none and is linked with nothing, as is a null doc_id (its component is null, it is
kept). Repeated ids are told apart by their text; `keep_first`
keeps one row of a group even so, but all rows without words or id. An empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, bound_batches, cut_lineage, fresh, map_texts, table

SHINGLE = 5
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 40, 4
SIZE = BANDS * ROWS
#: Shingles in the rows, and in the columns, of a cell of nodes that a task compares.
CELL = 150_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts, text after text and in order, and how many each text has."""
    hashes, sizes = [], []
    for t in texts:
        words = t.encode().lower().split()
        w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        if len(w) >= SHINGLE:
            n = len(w) - SHINGLE + 1
            total = w[:n] * _ODD[0]
            for k in range(1, SHINGLE):
                total = mix(total) + w[k : k + n] * _ODD[k]
            own = np.unique(mix(total))
        elif len(w):
            own = np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
        else:
            own = w
        hashes.append(own)
        sizes.append(len(own))
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.array(sizes, np.int64)


def sketches(elements: np.ndarray, sizes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Coordinates (sets x size): the round in the high half, the hash in the low half. Empty sets keep the largest value."""
    n = len(sizes)
    out = np.full(n * size, np.iinfo(np.uint64).max, np.uint64)
    of = np.repeat(np.arange(n), sizes)
    x = elements
    for i in range(2 * size):
        h = mix(x + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64))
        at = (((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64) if i < size else i - size
        np.minimum.at(out, of * size + at, np.uint64(i << 32) | (h & np.uint64(0xFFFFFFFF)))
        full = (out.reshape(n, size) != np.iinfo(np.uint64).max).all(axis=1)
        more = ~full[of]
        if not more.any():
            break
        if not more.all():
            x, of = x[more], of[more]
    return out.reshape(n, size)


def band_hashes(sketch: np.ndarray) -> np.ndarray:
    total = np.zeros((len(sketch), BANDS), np.uint64)
    parts = sketch.reshape(len(sketch), BANDS, ROWS)
    for k in range(ROWS):
        total = mix(total + parts[:, :, k] * _ODD[k])
    return mix(total + np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[4])


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, digest of the set and band hashes."""

    def score():
        def work(texts: list[str]) -> list[pa.Array]:
            elements, sizes = shingles(texts)
            ends = np.cumsum(sizes)
            digest = [hashlib.blake2b(elements[e - s : e].tobytes(), digest_size=16).digest() for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            bands = band_hashes(sketches(elements, sizes)).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))
            return [pa.array(sizes), pa.array(digest, pa.binary()), lists]

        return work

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return map_texts(docs, ["doc_id", "text_key"], "n_shingles long, digest binary, bands array<long>", score)


def _if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


_LINK = T.StructType([T.StructField(c, T.BinaryType()) for c in ("a", "b")])


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and text of the documents with these ids."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(_if_small(ids.distinct()), "id", "left_semi")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The links among pairs (a_doc, a, b_doc, b; a and b are digests), by the full sets of the documents' texts."""
    texts = _texts(docs, pairs.select(F.explode(F.array("a_doc", "b_doc")).alias("id")))
    a, b = (texts.select(F.col("id").alias(f"{s}_doc"), F.col("text").alias(f"{s}_text")) for s in "ab")
    both = pairs.join(a, "a_doc").join(b, "b_doc").select("a", "b", "a_text", "b_text")

    def run(batches):
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            size = max(1, batch.num_rows * (8 << 20) // max(1, batch.nbytes))
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                col = {c: part.column(part.schema.get_field_index(c)) for c in ("a", "b", "a_text", "b_text")}
                sets: dict[bytes, np.ndarray] = {}
                keys = [col[c].to_pylist() for c in ("a", "b")]
                for key, text in ((keys[0], col["a_text"]), (keys[1], col["b_text"])):
                    for i, digest in enumerate(key):
                        if digest not in sets:
                            own, _ = shingles([text[i].as_py() or ""])
                            # A repeated id may bring another text: it is not the node's.
                            if hashlib.blake2b(own.tobytes(), digest_size=16).digest() == digest:
                                sets[digest] = own
                for x, y in zip(*keys, strict=True):
                    if (p := sets.get(x)) is not None and (q := sets.get(y)) is not None:
                        both = len(np.intersect1d(p, q, assume_unique=True))
                        if 100 * both >= PERCENT * (len(p) + len(q) - both):
                            found.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    bound_batches(both)
    return both.mapInArrow(run, _LINK).distinct()


def components(links: DataFrame) -> DataFrame:
    """id and root for the ends of links (columns a, b): the smallest id that can be reached.

    Labels spread along the links and jump to their label's label, so the rounds grow with the logarithm
    of a component's diameter. Each round is written to the checkpoint folder.
    """
    edges = cut_lineage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter(F.col("a") != F.col("b")).distinct())
    labels = cut_lineage(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        spread = labels.join(near, "id").select("id", F.least("root", "near").alias("to"), F.col("root").alias("was"))
        jump = labels.select(F.col("id").alias("to"), F.col("root").alias("beyond"))
        after = cut_lineage(spread.join(jump, "to", "left").select("id", F.least("to", F.coalesce("beyond", "to")).alias("root"), "was"))
        changed = not after.filter(F.col("root") != F.col("was")).isEmpty()
        labels = after.select("id", "root")
        if not changed:
            return labels


def _joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """id and root after further links: only the components that these touch are looked at again."""
    ends = more.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(roots.select("id"), "id", "left_anti")
    known = cut_lineage(roots.unionByName(ends.select("id", F.col("id").alias("root"))))
    of = lambda side: known.select(F.col("id").alias(side), F.col("root").alias(f"{side}_root"))
    over = components(more.join(of("a"), "a").join(of("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
    over = over.select(F.col("id").alias("root"), F.col("root").alias("over"))
    return cut_lineage(known.join(over, "root", "left").select("id", F.coalesce("over", "root").alias("root")))


def _across(cell: pa.Table) -> pa.Table:
    """Links (a, b) that join parts, from the rows of a cell that are outside the largest part to all its columns."""
    digest, part = cell.column("digest").to_pylist(), cell.column("part").to_pylist()
    row, column = (cell.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("row", "column"))
    elements, sizes = shingles([t or "" for t in cell.column("text").to_pylist()])
    ends = np.cumsum(sizes)
    own = np.array([hashlib.blake2b(elements[e - s : e].tobytes(), digest_size=16).digest() == d for s, e, d in zip(sizes.tolist(), ends.tolist(), digest, strict=True)])
    column &= own  # a repeated id may bring another text: it is not the node's
    values, index = np.unique(elements, return_inverse=True)
    at = np.flatnonzero(column)
    beside = np.concatenate([index[ends[k] - sizes[k] : ends[k]] for k in at.tolist()]) if len(at) else index[:0]
    starts = np.cumsum(sizes[at]) - sizes[at]
    joined = {p: p for p in part}

    def root(p: bytes) -> bytes:
        while joined[p] != p:
            joined[p] = p = joined[joined[p]]
        return p

    links, marks = [], np.zeros(len(values), np.int64)
    for i in np.flatnonzero(row & own).tolist() if len(at) else ():
        mine = index[ends[i] - sizes[i] : ends[i]]
        marks[mine] = 1
        both = np.add.reduceat(marks[beside], starts)
        marks[mine] = 0
        for k in at[100 * both >= PERCENT * (sizes[i] + sizes[at] - both)].tolist():
            if (p := root(part[i])) != (q := root(part[k])):
                joined[p] = q
                links.append((digest[i], digest[k]))
    return pa.table({c: pa.array([x[k] for x in links], pa.binary()) for k, c in enumerate("ab")})


def across_parts(stars: DataFrame, roots: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) among the nodes around each centre that are in different parts."""
    parts = stars.join(roots.select(F.col("id").alias("a"), "root"), "a", "left").select("a", "a_doc", "a_size", "b", F.coalesce("root", "a").alias("part"))
    counts = parts.groupBy("b", "part").agg(F.struct(F.count(F.lit(1)), F.sum("a_size").alias("size")).alias("n"))
    opened = counts.groupBy("b").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("n.size").alias("size"), F.max(F.struct("n", "part")).alias("most")).filter(F.col("n_parts") > 1)
    outside = F.col("size") - F.col("most.n.size")
    opened = opened.select("b", F.col("most.part").alias("largest"), F.ceil(outside / CELL).cast("int").alias("rows"), F.ceil(F.col("size") / CELL).cast("int").alias("columns"))
    opened = _if_small(cut_lineage(opened))  # beside the few centres that are open, the many nodes of one needn't be dealt by it
    members = parts.join(opened, "b").withColumns(
        {"outside": F.col("part") != F.col("largest"), "i": F.pmod(F.xxhash64("a"), F.col("rows")).cast("int"), "j": F.pmod(F.xxhash64("a", F.lit(1)), F.col("columns")).cast("int")}
    )
    as_column = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: F.struct(r.alias("r"), F.col("j").alias("c")))
    as_row = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda c: F.struct(F.col("i").alias("r"), c.alias("c")))
    members = members.withColumn("cell", F.explode(F.when(F.col("outside"), F.array_union(as_column, as_row)).otherwise(as_column)))
    members = cut_lineage(
        members.select(
            F.col("b").alias("centre"), "cell.r", "cell.c", F.col("a").alias("digest"), F.col("a_doc").alias("id"), "part",
            (F.col("outside") & (F.col("cell.r") == F.col("i"))).alias("row"), (F.col("cell.c") == F.col("j")).alias("column"),
        )
    )
    return members.join(_texts(docs, members.select("id")), "id").groupBy("centre", "r", "c").applyInArrow(_across, _LINK).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key and group_key (null: linked with nothing) of every row of docs."""
    rows = cut_lineage(sketched(docs))
    nodes = rows.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("digest")
    nodes = cut_lineage(nodes.agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")))
    banded = nodes.select("digest", "doc", "n_shingles", F.explode("bands").alias("band"))

    # Every node of a bucket (a) with the one of smallest doc_id, the centre (b).
    centre = banded.groupBy("band").agg(F.min(F.struct("doc", "digest", "n_shingles")).alias("c"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    stars = banded.join(centre, "band").filter(F.col("digest") != F.col("c.digest"))
    stars = stars.select(F.col("digest").alias("a"), F.col("doc").alias("a_doc"), F.col("n_shingles").alias("a_size"), F.col("c.digest").alias("b"), F.col("c.doc").alias("b_doc"), F.col("c.n_shingles").alias("b_size"))
    stars = cut_lineage(stars.dropDuplicates(["a", "b"]))
    fits = 100 * F.least("a_size", "b_size") >= PERCENT * F.greatest("a_size", "b_size")
    links = cut_lineage(verified(stars.filter(fits), docs))
    roots = components(links)
    more = cut_lineage(across_parts(stars, roots, docs))
    if not more.isEmpty():
        roots = _joined(roots, more)

    smallest = roots.join(nodes.select(F.col("digest").alias("id"), "doc"), "id").groupBy("root").agg(F.min("doc").alias("component"))
    of_node = nodes.select("digest", "doc").join(roots.withColumnRenamed("id", "digest"), "digest", "left").join(smallest, "root", "left")
    of_node = of_node.select(F.col("digest").alias("node"), F.coalesce("component", "doc").alias("component"), F.coalesce("root", "digest").alias("group"))
    out = rows.join(of_node, F.col("digest") == F.col("node"), "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    group = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("group"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "text_key", group.alias("group_key")).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_key", "group_key"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their group."""
    marks = near_duplicates(docs)
    gone_id, gone_key = fresh(docs, "gone_id", "gone_key")
    gone = marks.filter(~F.col("kept")).select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key)).distinct()
    out = docs.join(_if_small(gone), (F.col("doc_id") == F.col(gone_id)) & (F.xxhash64("text") == F.col(gone_key)), "left_anti")
    repeated = cut_lineage(docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    return out if repeated.isEmpty() else _first_of_repeated(out, marks, repeated)


def _first_of_repeated(docs: DataFrame, marks: DataFrame, repeated: DataFrame) -> DataFrame:
    """docs with one row where several of a group carry its smallest id: that of smallest text_key, and one of equal rows.

    Groups are told apart by group_key, as unrelated texts under one id have the same component_id.
    """
    same = marks.filter(F.col("kept") & F.col("group_key").isNotNull()).join(_if_small(repeated), "doc_id", "left_semi")
    same = cut_lineage(same.groupBy("group_key", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")))
    first = same.groupBy("group_key", "doc_id").agg(F.min("text_key").alias("first_key"), F.sum("n").alias("rows")).filter("rows > 1")
    several = same.drop("n").join(first, ["group_key", "doc_id"])
    s_id, s_key, s_first = fresh(docs, "s_id", "s_key", "s_first")
    several = cut_lineage(several.select(F.col("doc_id").alias(s_id), F.col("text_key").alias(s_key), (F.col("text_key") == F.col("first_key")).alias(s_first)))
    at = (F.col("doc_id") == F.col(s_id)) & (F.xxhash64("text") == F.col(s_key))
    one = docs.join(_if_small(several.filter(F.col(s_first))), at, "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(_if_small(several), at, "left_anti").union(one)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key", "group_key")


#: DuckDB: all pairs that share a shingle, and a recursive walk along the links.
SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents
), s as (select doc_id, case when len(words) >= 5 then list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))) when len(words) > 0 then [array_to_string(words, ' ')] else [] end as sh from w
), x as (select doc_id, len(sh) as n, unnest(sh) as g from s
), l as (select a.doc_id as a, b.doc_id as b from x a join x b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
), e as (select a, b from l union all select b, a from l
), r(doc, seen) as (select doc_id, doc_id from s union select e.b, r.seen from r join e on e.a = r.doc
), m as (select doc, min(seen) as component_id from r group by doc)
select doc_id, len(sh) as n_shingles, component_id, doc_id = component_id as kept from s join m on doc = doc_id
"""
