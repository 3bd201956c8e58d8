"""Hard negatives by one-dimensional distance keys.

The search is for the largest inner products. With one more coordinate, sqrt(M - |x|^2) for a row and 0 for an anchor
(M: the largest squared length), squared distances are |q|^2 + M - 2 q.x, so the nearest rows have the largest products.
Every row is stored under its nearest pivot and sorted by its distance from it, in cells: rings of equal width around
each pivot, hashed into parts where a ring has more rows than a cell may have (copies have equal keys). By the triangle
inequality a row can be no nearer to an anchor than the two distances from the pivot differ. An anchor first
looks into the cell that it is stored in, which bounds its k-th product; then the rings go to it, and no others, whose
keys lie in the intervals that the bound leaves. Within a cell the scan expands from the anchor's own distance outwards,
block by block, and ends where the rest of the keys can hold nothing better than what is found: that certifies the top k.
Bounds are taken with some slack; the products themselves are of integers and exact, so the answer is. Pivots are centres
fitted to some SAMPLE rows; they decide only how many rings are passed over. In spaces of many dimensions without
clusters few are.

Positives are searched among the rows of the anchor's label, negatives among the others, below a share of each positive's
product. Anchors are packed in chunks and cells in rows of the table, so that a pair of them is one block of products.

Rows without id, label or vector, or with a component that is null or not finite, take no part. Repeated rows count each;
rows of an anchor's own id are never its positives or negatives, and repeated anchors answer each. Shorter
vectors are as if filled with zeros. Ties go to the smaller id. An empty table, or one without anchors, gives no rows; an
anchor without positives or negatives gives none. Other columns are not read. Components of which products could leave
the exact whole numbers of a double are refused with ValueError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut_lineage, if_small, table

POSITIVES, NEGATIVES = 5, 10
#: Bounds of a negative's product, in hundredths of the positive's.
LOW, HIGH = 30, 90
#: Pivots, rows that they are fitted to (drawn by a hash of the id, so many on average), rounds of fitting.
PIVOTS, SAMPLE, ROUNDS = 32, 4096, 8
#: Bytes of vectors in a cell, anchors in a chunk, rows of a block (on average, all three).
CELL_BYTES, CHUNK, BLOCK = 8 << 20, 512, 512

_CELL = ["pivot", "ring", "part"]


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of numbers as doubles, filled with zeros up to the width."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    of = np.repeat(np.arange(len(sizes)), sizes)
    out[of, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


class Space:
    """What tasks need to know of the index; its size depends on the pivots and the width of vectors only."""

    def __init__(self, width: int, kind: str, most: float):
        self.width, self.kind, self.most = width, kind, most
        self.pivots = np.zeros((1, width + 1))

    def packed(self, lists: pa.Array) -> pa.Array:
        rows = np.ascontiguousarray(_matrix(lists, self.width).astype(self.kind))
        return pa.array([r.tobytes() for r in rows], pa.binary())

    def unpacked(self, column: pa.Array) -> np.ndarray:
        size = self.width * np.dtype(self.kind).itemsize
        if not size:
            return np.zeros((len(column), 0))
        fixed = column.cast(pa.binary(size))
        return np.frombuffer(fixed.buffers()[1], self.kind).reshape(-1, self.width)[fixed.offset : fixed.offset + len(fixed)].astype(np.float64)

    def augmented(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(0, self.most - (x * x).sum(axis=1)))]

    def from_pivots(self, x: np.ndarray) -> np.ndarray:
        """Distances of augmented rows, or of anchors (which have 0 there), from every pivot."""
        x = x if x.shape[1] == self.width + 1 else np.c_[x, np.zeros(len(x))]
        p = self.pivots
        return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * x @ p.T))

    def slack(self) -> float:
        """More than rounding can do to a product that is derived from distances."""
        return 1 + 1e-6 * self.most

    def fit(self, rows: np.ndarray, n: int) -> None:
        """Centres of augmented rows by a few rounds of reassignment, from rows that differ."""
        x = self.augmented(rows)
        _, first = np.unique(x, axis=0, return_index=True)
        self.pivots = x[np.sort(first)[:n]]
        for _ in range(ROUNDS):
            nearest = self.from_pivots(x).argmin(axis=1)
            count = np.bincount(nearest, minlength=len(self.pivots))
            sums = np.zeros_like(self.pivots)
            np.add.at(sums, nearest, x)
            self.pivots = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], self.pivots)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _top(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each slot, by falling score, then id."""
    order = np.lexsort((ids, -score, slot))
    slot, score, ids = slot[order], score[order], ids[order]
    starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.array([], np.int64)
    place = np.arange(len(slot)) - np.repeat(starts, np.diff(np.r_[starts, len(slot)]))
    return slot[place < k], score[place < k], ids[place < k]


def scan(space: Space, cell: dict[str, np.ndarray], asks: dict[str, np.ndarray], pivot: int, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """slot (ask * ranges + range), product and id of the best k rows of a cell for each range [least, top] of each ask.

    cell: key (sorted), id, label, x. asks: id, label, x, least and top (a column for each range).
    """
    keys, x, q = cell["key"], cell["x"], asks["x"]
    least, top = asks["least"].copy(), asks["top"]
    n_ranges = top.shape[1]
    own = space.from_pivots(q)[:, pivot][:, None]
    base = (q * q).sum(axis=1)[:, None] + space.most
    starts = np.arange(0, len(keys), BLOCK)
    lo, hi = keys[starts], keys[np.minimum(starts + BLOCK, len(keys)) - 1]
    gap = np.maximum(0, np.maximum(own - hi, lo - own))
    most = (base - gap * gap) / 2 + space.slack()
    fewest = (base - (own + hi) ** 2) / 2 - space.slack()
    outwards = np.argsort(gap, axis=1, kind="stable")
    held = (np.array([], np.int64), np.array([]), np.array([], np.int64))
    every = np.arange(len(q))
    for step in range(len(starts)):
        at = outwards[:, step]
        useful = (most[every, at][:, None] >= least) & (fewest[every, at][:, None] <= top) & (least <= top)
        asking = useful.any(axis=1)
        for b in np.unique(at[asking]):
            rows = np.flatnonzero(asking & (at == b))
            part = slice(starts[b], starts[b] + BLOCK)
            score = q[rows] @ x[part].T
            fits = ((cell["label"][part] == asks["label"][rows, None]) == same) & (cell["id"][part] != asks["id"][rows, None])
            found = [held]
            for r in range(n_ranges):
                some = np.flatnonzero(useful[rows, r])
                if not len(some):
                    continue
                s, of = score[some], rows[some]
                s = np.where(fits[some] & (s >= least[of, r, None]) & (s <= top[of, r, None]), s, -np.inf)
                if s.shape[1] > k:
                    s = np.where(s >= np.partition(s, s.shape[1] - k, axis=1)[:, -k, None], s, -np.inf)
                i, j = np.nonzero(s > -np.inf)
                found.append((of[i] * n_ranges + r, s[i, j], cell["id"][part][j]))
            held = _top(*(np.concatenate(c) for c in zip(*found, strict=True)), k)
            slots, count = np.unique(held[0], return_counts=True)
            last = np.cumsum(count)[count == k] - 1
            least.reshape(-1)[slots[count == k]] = held[1][last]
    return held


class Index:
    """Rows under their pivots, in cells sorted by distance."""

    def __init__(self, rows: DataFrame):
        """rows: vec_id, label, vector (an array of whole numbers as doubles); none of them null."""
        self.spark = rows.sparkSession
        v = F.col("vector")
        size = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
        peak = F.aggregate(v, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
        self.n, width, most, peak = rows.agg(F.count(F.lit(1)), F.max(F.size(v)), F.max(size), F.max(peak)).first()
        if not self.n:
            return
        if width * peak * peak >= 2.0**53:
            raise ValueError("components are too large for exact products")
        self.space = space = Space(width, "<i2" if peak < 2**15 else "<i4", float(most))
        drawn = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < F.lit(max(1, (1 << 40) * min(1.0, SAMPLE / self.n)))).select("vector").toArrow()
        sample = _matrix(drawn.column("vector").combine_chunks(), width) if drawn.num_rows else np.zeros((1, width))
        space.fit(sample[:: max(1, len(sample) // (4 * SAMPLE))], PIVOTS)
        self.rows = self._cells_of(cut_lineage(self._keyed(rows)))
        packed = self.rows.groupBy(*_CELL).agg(F.array_sort(F.collect_list(F.struct("key", "vec_id", "label", "v"))).alias("rows"))
        self.cells = cut_lineage(packed)

    def _keyed(self, rows: DataFrame) -> DataFrame:
        space = self.space

        def run(batches):
            for batch in batches:
                lists = _column(batch, "vector")
                distance = space.from_pivots(space.augmented(_matrix(lists, space.width)))
                pivot = distance.argmin(axis=1)
                made = [pa.array(pivot.astype(np.int32)), pa.array(distance[np.arange(len(pivot)), pivot]), space.packed(lists)]
                yield pa.RecordBatch.from_arrays([_column(batch, "vec_id"), _column(batch, "label"), *made], names=["vec_id", "label", "pivot", "key", "v"])

        bound_batches(rows)
        return rows.select("vec_id", "label", "vector").mapInArrow(run, "vec_id long, label long, pivot int, key double, v binary")

    def _cells_of(self, keyed: DataFrame) -> DataFrame:
        """keyed with ring and part; also keeps the rings of every pivot, and how many parts each ring has."""
        most = max(1, CELL_BYTES // max(1, self.space.width * np.dtype(self.space.kind).itemsize))
        found = keyed.groupBy("pivot").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n")).collect()  # a row for each pivot
        self.rings = {r.pivot: (r.lo, max((r.hi - r.lo) / -(-r.n // most), 1e-9), r.hi) for r in found}
        edges = F.broadcast(self.spark.createDataFrame([(p, lo, width, -(-r.n // most)) for r in found for p, (lo, width, _) in [(r.pivot, self.rings[r.pivot])]], "pivot int, lo double, width double, n_rings long"))
        ring = F.least(F.floor((F.col("key") - F.col("lo")) / F.col("width")), F.col("n_rings") - 1).cast("int")
        placed = keyed.join(edges, "pivot").select("vec_id", "label", "pivot", ring.alias("ring"), "key", "v")
        parts = placed.groupBy("pivot", "ring").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("n_parts"))
        self.parts = cut_lineage(parts)
        part = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("n_parts")).cast("int")
        return cut_lineage(placed.join(if_small(self.parts), ["pivot", "ring"]).select("vec_id", "label", *_CELL[:2], part.alias("part"), "key", "v"))

    def _rings_left(self, asks: DataFrame) -> DataFrame:
        """asks, a row for each cell beside their own that their bounds leave."""
        space, rings = self.space, sorted(self.rings.items())

        def run(batches):
            for batch in batches:
                q = space.unpacked(_column(batch, "v"))
                least, top = (_matrix(_column(batch, c), 1 if not batch.num_rows else len(_column(batch, c)[0])) for c in ("least", "top"))
                open_ = least <= top
                base = (q * q).sum(axis=1) + space.most
                reach = np.sqrt(np.maximum(0, base - 2 * (np.where(open_, least, np.inf).min(axis=1) - space.slack())))
                inner = np.sqrt(np.maximum(0, base - 2 * (np.where(open_, top, -np.inf).max(axis=1) + space.slack())))
                own = space.from_pivots(q)
                out: list[tuple[np.ndarray, ...]] = []
                for p, (lo, width, hi) in rings:
                    a = np.maximum(np.maximum(own[:, p] - reach, inner - own[:, p]), lo)
                    b = np.minimum(own[:, p] + reach, hi)
                    who = np.flatnonzero(open_.any(axis=1) & (a <= b))
                    out.append((who, np.full(len(who), p), np.floor((a[who] - lo) / width), np.floor((b[who] - lo) / width)))
                who, pivot, first, last = (np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True))
                part = batch.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c.astype(np.int32)) for c in (pivot, first, last))], names=[*part.schema.names, "pivot", "first", "last"])

        kept = ["ask", "anchor_id", "label", "v", "least", "top", "home"]
        schema = ", ".join(f"{c} {asks.schema[c].dataType.simpleString()}" for c in kept) + ", pivot int, first int, last int"
        found = asks.select(*kept).mapInArrow(run, schema)
        found = found.withColumn("ring", F.explode(F.sequence("first", "last"))).join(if_small(self.parts), ["pivot", "ring"])
        found = found.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
        return found.filter(F.struct(*_CELL) != F.col("home"))

    def _asked(self, asks: DataFrame, n: int, same: bool, k: int) -> DataFrame:
        """ask, range, score and vec_id: the best k of each cell that a row of asks names."""
        chunk = F.pmod(F.xxhash64("ask"), F.lit(max(1, -(-n // CHUNK)))).alias("chunk")
        chunks = asks.groupBy(*_CELL, chunk).agg(F.collect_list(F.struct("ask", "anchor_id", "label", "v", "least", "top")).alias("asks"))
        space = self.space

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    rows, own = (_column(batch, c).slice(i, 1).flatten() for c in ("rows", "asks"))
                    number = lambda s, c: s.field(c).to_numpy(zero_copy_only=False)
                    cell = {"key": number(rows, "key"), "id": number(rows, "vec_id"), "label": number(rows, "label"), "x": space.unpacked(rows.field("v"))}
                    ranges = len(own.field("top")[0])
                    asked = {"id": number(own, "anchor_id"), "label": number(own, "label"), "x": space.unpacked(own.field("v")), "least": _matrix(own.field("least"), ranges), "top": _matrix(own.field("top"), ranges)}
                    slot, score, ids = scan(space, cell, asked, _column(batch, "pivot")[i].as_py(), same, k)
                    ask = number(own, "ask")[slot // ranges]
                    yield pa.RecordBatch.from_arrays([pa.array(ask), pa.array((slot % ranges).astype(np.int32)), pa.array(score.astype(np.int64)), pa.array(ids)], names=["ask", "range", "score", "vec_id"])

        return self.cells.join(chunks, _CELL).select("pivot", "rows", "asks").mapInArrow(run, "ask long, range int, score long, vec_id long")

    def best(self, asks: DataFrame, n: int, same: bool, k: int) -> DataFrame:
        """ask, range, score, vec_id and rank: for each range of products [least, top] of each ask its best k rows.

        asks: ask (a number), anchor_id, label, v, home (its cell) and the arrays least and top, equally long in all rows;
        n of them. Rows have to have the ask's label, or another one.
        """
        first = cut_lineage(self._asked(asks.select("*", *[F.col(f"home.{c}").alias(c) for c in _CELL]), n, same, k))
        rank = F.row_number().over(Window.partitionBy("ask", "range").orderBy(F.desc("score"), "vec_id"))
        bounds = first.groupBy("ask", "range").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("least")).filter(F.col("n") >= k)
        bounds = bounds.groupBy("ask").agg(F.map_from_entries(F.collect_list(F.struct("range", "least"))).alias("bounds"))
        raised = F.transform("least", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("bounds", i), x)))
        left = self._rings_left(asks.join(bounds, "ask", "left").withColumn("least", raised).drop("bounds"))
        found = first.unionByName(self._asked(left, n, same, k))
        return cut_lineage(found.withColumn("rank", rank).filter(F.col("rank") <= k))


def mined(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    vectors: vec_id, label and vector, an array of whole numbers (of any type); anchors are the rows for which `anchor` holds.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = cut_lineage(rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    index = Index(rows)
    if not index.n:
        return rows.sparkSession.createDataFrame([], schema)
    own = index.rows.filter(anchor).select(F.monotonically_increasing_id().alias("ask"), F.col("vec_id").alias("anchor_id"), "label", "v", F.struct(*_CELL).alias("home"))
    own = cut_lineage(own)
    n = own.count()
    anything = own.select("*", F.array(F.lit(-(2.0**53))).alias("least"), F.array(F.lit(2.0**53)).alias("top"))
    found = index.best(anything, n, True, positives).select("ask", F.col("rank").alias("no"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    s = F.col("positive_score").cast("double")
    limits = F.struct("no", F.ceil(low * s / 100).cast("double").alias("least"), F.floor(high * s / 100).cast("double").alias("top"))
    limits = found.groupBy("ask").agg(F.map_from_entries(F.collect_list(F.struct(F.col("no"), limits))).alias("of"))
    # A range for each positive; where there are fewer, an empty one.
    each = lambda name, none: F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.try_element_at("of", i)[name], F.lit(none)))
    asks = own.join(limits, "ask").select(*own.columns, each("least", 1.0).alias("least"), each("top", 0.0).alias("top"))
    negative = index.best(asks, n, False, negatives)
    out = negative.select("ask", (F.col("range") + 1).alias("no"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(found, ["ask", "no"])
    return out.join(own.select("ask", "anchor_id"), "ask").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    scaled = F.transform("embedding", lambda x: F.lit(256.0) * x.cast("double"))
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))  # beyond that all doubles are whole
    vectors = e.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), whole.alias("vector"))
    return mined(vectors, F.col("vec_id") % 100 == 0)


#: DuckDB: all products of anchors.
SQL = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), p as (select anchor_id, other as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5
), n as (select p.*, other as negative_id, score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by score desc, other) as rank
  from p join s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""
