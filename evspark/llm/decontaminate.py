"""Benchmark decontamination by winnowing, in DataFrame operations only.

Every text becomes words, hashed k-grams of words, and of each window of neighbouring k-grams the smallest
hash is kept. With k + w - 1 = 10 two texts that share 10 words share a kept hash, so joining the
fingerprints of documents and benchmark items finds every document that can have a hit. These documents
are then extended from the places of the fingerprints found: the windows around these places are joined
with the items' windows as words, and the hit spans are merged into counts. An item of fewer than 10 words is one window of its own length; documents
are fingerprinted with all k-grams of those lengths as well (at most nine, only where such items exist).

Fingerprints and windows of the benchmark, and ids of hit documents, are broadcast only if their bytes are summed up to few
(if_small); otherwise the same joins shuffle. Partial aggregation brings a document's matches down to one row before
anything is shuffled, so neither a frequent passage nor a long document makes a large group.

Null and empty texts have no words. Documents are told apart by doc_id and a hash of the text, so repeated
rows and repeated ids get a row each with their own counts. A null item_id is listed as ''. Empty tables
give no rows or no hits. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, fresh, if_small, table

#: Words of a window, of a k-gram, and k-grams of which the smallest is kept.
WINDOW, GRAM = 10, 6
KEPT_OF = WINDOW - GRAM + 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of digits, a to z (A to Z is lower-cased first) and all non-ASCII characters."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _NO_WORD), lambda w: w != "")


def _pairs(df: DataFrame, out: str, left: str, right: str, shift: int, f) -> DataFrame:
    """Column out: f of left[i] and right[i + shift], for every i that has both."""
    n = F.greatest(F.lit(0), F.least(F.size(left), F.size(right) - shift))
    return df.withColumn(out, F.zip_with(F.slice(left, 1, n), F.slice(right, F.lit(1 + shift), n), f))


def _grams(df: DataFrame, k: int, out: str) -> DataFrame:
    """Column out: hashes of all k-grams of column `h1`, put together from those of powers of two."""
    size, have = 1, "h1"
    done = {1: "h1"}
    while size * 2 <= k:
        if f"h{size * 2}" not in df.columns:
            df = _pairs(df, f"h{size * 2}", have, have, size, lambda a, b: F.xxhash64(a, b))
        size, have = size * 2, f"h{size * 2}"
        done[size] = have
    rest, at = k - size, have
    while rest:
        part = max(s for s in done if s <= rest)
        name = f"h{size}_{part}"
        if name not in df.columns:
            df = _pairs(df, name, at, done[part], size, lambda a, b: F.xxhash64(a, b))
        size, rest, at = size + part, rest - part, name
    return df.withColumn(out, F.col(at))


def _smallest(df: DataFrame, grams: str, of: int, out: str) -> DataFrame:
    """Column out: distinct minima of each `of` neighbours of column grams."""
    size, have = 1, grams
    while size * 2 <= of:
        df = _pairs(df, f"m{size * 2}", have, have, size, lambda a, b: F.least(a, b))
        size, have = size * 2, f"m{size * 2}"
    if size < of:
        df = _pairs(df, "m_last", have, have, of - size, lambda a, b: F.least(a, b))
        have = "m_last"
    return df.withColumn(out, F.array_distinct(have))


def _of_length(m: int):
    return lambda h: F.xxhash64(h, F.lit(m))


def fingerprints(df: DataFrame, out: str, lengths: list[int]) -> DataFrame:
    """df (with array column words) and column out: kept hashes of 10-word windows, and all grams of the given shorter lengths."""
    keep = df.columns
    df = _hashed(df)
    df = _smallest(_grams(df, GRAM, "grams"), "grams", KEPT_OF, "kept")
    for m in lengths:
        df = _grams(df, m, f"short{m}")
    return df.select(*keep, F.array_distinct(F.concat("kept", *[F.transform(f"short{m}", _of_length(m)) for m in lengths])).alias(out))


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))


def extended(docs: DataFrame, prints: DataFrame, short: list[int]) -> DataFrame:
    """doc_id, text_key, pos, length and gram (its words) of the windows of docs that hold a fingerprint of `prints` (column print).

    A k-gram whose hash is a fingerprint can lie in the KEPT_OF windows that start at or before it; every window that a
    document shares with an item has such a k-gram. For windows of the shorter lengths the fingerprint is the whole window.
    """
    keys = ["doc_id", "text_key"]
    seeds = _grams(_hashed(docs), GRAM, "grams")
    for m in short:
        seeds = _grams(seeds, m, f"short{m}")
    of = [(WINDOW, KEPT_OF, F.col("grams"))] + [(m, 1, F.transform(f"short{m}", _of_length(m))) for m in short]
    seeds = seeds.select(*keys, *[h.alias(f"of{m}") for m, _, h in of])
    placed = lambda m, back: F.transform(f"of{m}", lambda h, i: F.struct(F.lit(m).alias("length"), F.lit(back).alias("back"), i.alias("at"), h.alias("print")))
    at = F.flatten(F.array(*[placed(m, back) for m, back, _ in of]))
    found = seeds.select(*keys, F.explode_outer(at).alias("s")).select(*keys, "s.*").join(prints.select("print"), "print")
    starts = F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("back") + 1), F.col("at")))
    starts = found.select(*keys, "length", starts.alias("pos")).groupBy(*keys).agg(F.collect_set(F.struct("length", "pos")).alias("starts"))
    starts = starts.select(F.col("doc_id").alias("s_id"), F.col("text_key").alias("s_key"), "starts")
    both = docs.join(starts, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("text_key") == F.col("s_key"))).select(*keys, "words", "starts")
    fits = F.filter("starts", lambda s: s["pos"] + s["length"] <= F.size("words"))
    texts = F.transform(fits, lambda s: F.struct(s["pos"].alias("pos"), s["length"].alias("length"), F.array_join(F.slice("words", s["pos"] + 1, s["length"]), " ").alias("gram")))
    return both.select(*keys, F.explode_outer(texts).alias("w")).select(*keys, "w.*").filter(F.col("pos").isNotNull())


def windows(words: Column, length: Column | int) -> Column:
    """All windows of `length` words, as text, in order."""
    n = F.size(words) - length
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.array_join(F.slice(words, i + 1, length), " "))).otherwise(F.array().cast("array<string>"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, n_items, items (sorted ids as text) for every row of docs."""
    docs = docs.select("doc_id", "text")
    bench = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    bench = bench.withColumn("length", F.least(F.lit(WINDOW), F.size("words")))
    short = sorted(r[0] for r in bench.filter(F.col("length") < WINDOW).select("length").distinct().collect())  # at most nine

    of_items = fingerprints(bench.filter(F.col("length") == WINDOW).select("item", "words"), "prints", []).select(F.explode_outer("prints").alias("print"))
    for m in short:
        whole = _grams(_hashed(bench.filter(F.col("length") == m)), m, "whole")
        of_items = of_items.unionByName(whole.select(_of_length(m)(F.element_at("whole", 1)).alias("print")))
    # explode_outer here and below: for explode Spark infers a filter, and copies the nested expressions into it.
    of_items = if_small(of_items.filter(F.col("print").isNotNull()).distinct().withColumn("found", F.lit(1)))

    each = fingerprints(_keyed(docs).withColumn("n_words", F.size("words").cast("long")), "prints", short)
    each = each.select("doc_id", "text_key", "n_words", F.explode_outer("prints").alias("print"))
    marked = each.join(of_items, "print", "left").groupBy("doc_id", "text_key", "n_words").agg(F.max("found").alias("found"))
    marked = cut_lineage(marked)  # a small row for each document, read three times

    hit_keys = if_small(marked.filter(F.col("found") == 1).select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")))
    own = docs.withColumn("text_key", F.xxhash64("text")).join(hit_keys, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left_semi")
    own = own.dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", words_of(F.col("text")).alias("words"))
    places = cut_lineage(extended(own, of_items, short))
    of_bench = bench.select("item", "length", F.explode(windows(F.col("words"), F.col("length"))).alias("gram")).distinct()
    hits = places.join(if_small(of_bench), ["length", "gram"]).select("doc_id", "text_key", "pos", "length", "item")

    by_doc = ["doc_id", "text_key"]
    spans = hits.groupBy(*by_doc, "pos").agg(F.max("length").alias("length"))
    before = Window.partitionBy(*by_doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("pos") + F.col("length")
    spans = spans.withColumn("seen", F.coalesce(F.max(end).over(before), F.lit(0)))
    n_hit = spans.groupBy(*by_doc).agg(F.sum(F.greatest(F.lit(0), end - F.greatest("seen", "pos"))).alias("n_hit"))
    listed = hits.groupBy(*by_doc).agg(F.sort_array(F.collect_set("item")).alias("items"))
    both = n_hit.join(listed.select(F.col("doc_id").alias("l_id"), F.col("text_key").alias("l_key"), "items"), F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("text_key") == F.col("l_key")))
    both = both.select(F.col("doc_id").alias("b_id"), F.col("text_key").alias("b_key"), "n_hit", "items")

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"))
    marked = marked.select(F.col("doc_id").alias("m_id"), F.col("text_key").alias("m_key"), "n_words")
    out = rows.join(marked, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_key") == F.col("m_key")))
    out = out.join(both, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("text_key") == F.col("b_key")), "left")
    return out.select(
        "doc_id",
        "text_key",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that no window of an item occurs in."""
    hit_id, hit_key = fresh(docs, "hit_id", "hit_key")
    hit = contamination(docs, items).filter(F.col("n_hit") > 0).select(F.col("doc_id").alias(hit_id), F.col("text_key").alias(hit_key)).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col(hit_id)) & (F.xxhash64("text") == F.col(hit_key)), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: DuckDB: all windows against all windows, without fingerprints.
SQL = r"""
with d as (
  select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as words
  from documents
), b as (
  select coalesce(cast(item_id as varchar), '') as item, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as words
  from benchmark
), bw as (
  select distinct item, least(10, len(words)) as m, array_to_string(words[i + 1 : i + least(10, len(words))], ' ') as gram
  from (select item, words, unnest(range(0, len(words) - least(10, len(words)) + 1)) as i from b where len(words) > 0)
), dw as (
  select r, m, i, array_to_string(words[i + 1 : i + m], ' ') as gram
  from (select r, words, m, unnest(range(0, len(words) - m + 1)) as i from d, (select distinct m from bw) where len(words) >= m)
), hits as (select r, i, dw.m, item from dw join bw on dw.gram = bw.gram and dw.m = bw.m
), covered as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + m)) as p from hits) group by r
), listed as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hits group by r)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (r) left join listed using (r)
"""
