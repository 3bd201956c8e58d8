"""How far the sources of a language are from each other, and which words set them apart.

Words are counted by language and source inside tasks, and the partial counts are summed. A language keeps the words
that at least `least_docs` of its documents have. A kept word's counts by source are a sparse vector, the sources
without it being left out; words of equal vectors are one row with a multiplicity. For two sources that both occur in
such a vector the difference of their shares is taken once and multiplied. Words that one or both sources lack need no
pair: of a source, only how often it has which share matters, and running sums over the shares give the differences
to any other source's share of a missing word.

With n occurrences of a word in a group, N of all kept words there and V kept words, the share is
1 + floor(UNIT * (n + PRIOR) / (N + PRIOR * V)), so all sums are exact. `audited` gives all ordered pairs of sources of
a language with the sum of absolute differences, and the `most_terms` words of each source whose share lies highest
over the language's.

Null text, language and source read as ''; every row is a document, whatever its id. Ties are ranked by the item's
UTF-8 bytes. A language without kept words has pairs of value 0 and no words; a source that is alone has no pairs; an
empty table gives no rows. Other columns are not read. Texts of any length are read whole, piece by piece.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut_lineage, if_small, table

LEAST_DOCS, MOST_TERMS = 30, 50
UNIT, PRIOR = 1_000_000_000, 5
#: Words that a task holds at most before it hands partial counts on (and those of one more text).
HELD = 1 << 18
#: Bytes of a text that are split at once, up to the next space.
PIECE = 1 << 20
#: Pairs of sources that a task works on at once.
PAIRS = 1 << 20
#: What becomes of each byte: letters in lower case, bytes over 127 as they are, all others spaces.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _pieces(data: bytes):
    lo = 0
    while lo < len(data):
        hi = data.find(b" ", lo + PIECE)
        hi = len(data) if hi < 0 else hi
        yield data[lo:hi].split()
        lo = hi


def _counted(batches):
    """lang, source, term, n and n_docs: partial counts, and a row of null term for each group."""
    held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
    size = 0

    def out():
        columns: list[list] = [[], [], [], [], []]
        for (lang, source), (n, docs) in held.items():
            for column, values in zip(columns, ([lang] * (len(n) + 1), [source] * (len(n) + 1), [None, *n], [0, *n.values()], [0, *[docs[t] for t in n]]), strict=True):
                column.extend(values)
        texts = [pa.array(c, pa.binary()).cast(pa.string()) for c in columns[:3]]
        return pa.RecordBatch.from_arrays([*texts, *(pa.array(c, pa.int64()) for c in columns[3:])], names=["lang", "source", "term", "n", "n_docs"])

    for batch in batches:
        langs, sources, texts = ([v or b"" for v in batch.column(batch.schema.get_field_index(c)).cast(pa.binary()).to_pylist()] for c in ("lang", "source", "text"))
        for group, text in zip(zip(langs, sources, strict=True), texts, strict=True):
            n, docs = held.setdefault(group, (Counter(), Counter()))
            before, own = len(n), set()
            for words in _pieces(text.translate(_BYTES)):
                n.update(words)
                own.update(words)
            docs.update(own)
            size += len(n) - before
            if size > HELD:
                yield out()
                held, size = {}, 0
    if held:
        yield out()
    pa.default_memory_pool().release_unused()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n occurrences and n_docs documents; of each group also a row of null term."""
    bound_batches(docs)
    partial = docs.select("lang", "source", "text").mapInArrow(_counted, "lang string, source string, term string, n long, n_docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def _share(n: Column, total: Column) -> Column:
    """Exact: products are decimals of up to 31 digits."""
    whole = F.lit(UNIT).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(20,0)")
    return 1 + F.call_function("div", whole, F.nullif(total, F.lit(0)).cast("decimal(20,0)"))


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(a, b, value) with a row for each (a, b)."""
    a, b, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((b, a))
    a, b, value = a[order], b[order], value[order]
    starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.array([], np.int64)
    return a[starts], b[starts], np.add.reduceat(value, starts) if len(a) else value


def _shared(batches):
    """What pairs of sources that both have a vector's words differ in, beyond what their running sums say."""
    parts: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("entries"))
        flat = lists.flatten()
        g, p, z = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        k = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        m = np.repeat(batch.column(batch.schema.get_field_index("m")).to_numpy(zero_copy_only=False), k)
        more = np.repeat(np.cumsum(k), k) - np.arange(len(g)) - 1  # partners of an entry: those after it in its vector
        done = np.cumsum(more)
        lo = 0
        while lo < len(g):
            hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + PAIRS, side="right")))
            i = np.repeat(np.arange(lo, hi), more[lo:hi])
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(more[lo:hi]) - more[lo:hi], more[lo:hi])
            value = m[i] * (abs(p[i] - p[j]) - abs(p[i] - z[j]) - abs(z[i] - p[j]) + abs(z[i] - z[j]))
            parts.append(_summed([(np.minimum(g[i], g[j]), np.maximum(g[i], g[j]), value)]))
            if sum(len(x[0]) for x in parts) > PAIRS:
                parts = [_summed(parts)]
                if len(parts[0][0]) > PAIRS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts.pop()], names=["a", "b", "value"])
            lo = hi
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(parts)], names=["a", "b", "value"])


def vectors(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, total and counts (source and n, sorted) of the words that are kept."""
    by_term = counts.filter(F.col("term").isNotNull()).groupBy("lang", "term")
    found = by_term.agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("counts"))
    return found.filter(F.col("n_docs") >= least_docs).select("lang", "term", "total", "counts")


def _groups(counts: DataFrame, distinct: DataFrame) -> DataFrame:
    """g (a number), lang, source, n_kept words V, own and whole (divisors of the group's shares and of the language's), zero (share of a word that it lacks)."""
    each = distinct.select("lang", "m", F.inline("counts")).groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("own"))
    of_lang = distinct.groupBy("lang").agg(F.sum("m").alias("n_kept"))
    groups = counts.filter(F.col("term").isNull()).select("lang", "source").join(each, ["lang", "source"], "left").join(of_lang, "lang", "left")
    kept = F.coalesce("n_kept", F.lit(0)).cast("long")
    whole = F.sum(F.coalesce("own", F.lit(0))).over(Window.partitionBy("lang")) + PRIOR * kept
    own = F.coalesce("own", F.lit(0)) + PRIOR * kept
    return groups.select(F.monotonically_increasing_id().alias("g"), "lang", "source", kept.alias("n_kept"), own.alias("own"), whole.alias("whole"), _share(F.lit(0), own).alias("zero"))


def _pairs(distinct: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language) and value."""
    small = if_small(groups.select("lang", "source", "g", "own", "zero"))
    entries = distinct.select("v", "lang", "m", F.inline("counts")).join(small, ["lang", "source"])
    entries = cut_lineage(entries.select("v", "m", "g", _share(F.col("n"), F.col("own")).alias("p"), "zero"))
    both = entries.groupBy("v").agg(F.first("m").alias("m"), F.collect_list(F.struct("g", "p", "zero")).alias("entries")).filter(F.size("entries") > 1)
    both = both.select("m", "entries").mapInArrow(_shared, "a long, b long, value long")

    a, b = (groups.select("lang", *[F.col(c).alias(f"{s}_{c}") for c in ("g", "zero", "n_kept", "source")]) for s in "ab")
    pairs = cut_lineage(a.join(b, "lang").filter(F.col("a_g") != F.col("b_g")))  # as many rows as the result has
    # Of source a: how often it has which share, and where b's share of a missing word lies among these.
    shares = entries.groupBy("g", "p").agg(F.sum("m").alias("w")).select("g", F.col("p").alias("x"), "w", (F.col("w") * F.col("p")).alias("wp"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("zero"))
    points = pairs.select(F.col("a_g").alias("g"), F.col("b_zero").alias("x"), F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("wp"), F.col("b_g").alias("b"), F.col("a_zero").alias("zero"))
    whole = Window.partitionBy("g")
    upto = whole.orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = shares.unionByName(points).select("g", "b", "x", "zero", F.sum("w").over(upto).alias("w_le"), F.sum("wp").over(upto).alias("wp_le"), F.sum("w").over(whole).alias("w"), F.sum("wp").over(whole).alias("wp"))
    x = F.col("x")
    one = F.col("wp") - 2 * F.col("wp_le") - x * F.col("w") + 2 * x * F.col("w_le") - F.col("w") * F.abs(F.col("zero") - x)
    one = sums.filter(F.col("b").isNotNull()).select(F.col("g").alias("a"), "b", one.alias("value"))
    none = pairs.select(F.col("a_g").alias("a"), F.col("b_g").alias("b"), F.coalesce(F.col("a_n_kept") * F.abs(F.col("a_zero") - F.col("b_zero")), F.lit(0)).alias("value"))
    either = one.unionByName(both)
    value = none.unionByName(either).unionByName(either.select(F.col("b").alias("a"), F.col("a").alias("b"), "value")).groupBy("a", "b").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value"))
    named = pairs.select(F.col("a_g").alias("a"), F.col("b_g").alias("b"), "lang", F.col("a_source").alias("source"), F.col("b_source").alias("item"))
    return named.join(value, ["a", "b"]).select("lang", "source", "item", "value")


def _terms(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (a word that the source has) and value: by how much its share lies over the language's."""
    small = if_small(groups.select("lang", "source", "own", "whole"))
    found = terms.select("lang", F.col("term").alias("item"), "total", F.inline("counts")).join(small, ["lang", "source"])
    over = _share(F.col("n"), F.col("own")) - _share(F.col("total"), F.col("whole"))
    return found.select("lang", "source", "item", over.alias("value")).filter(F.col("value") > 0)


def audited(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value and rank (by falling value, then item) as the module says."""
    counts = cut_lineage(term_counts(docs))
    terms = cut_lineage(vectors(counts, least_docs))
    distinct = terms.groupBy("lang", "counts").agg(F.count(F.lit(1)).alias("m"))
    distinct = cut_lineage(distinct.select(F.monotonically_increasing_id().alias("v"), "lang", "counts", "m"))
    groups = cut_lineage(_groups(counts, distinct))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    named = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return named(_pairs(distinct, groups), "pair").unionByName(named(_terms(terms, groups), "term").filter(F.col("rank") <= most_terms))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"))


#: DuckDB: every share of every word in every group.
SQL = r"""
with d as (select row_number() over () as r, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents
), w as (select r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d
), k as (select lang, term, count(*)::hugeint as total from w group by lang, term having count(distinct r) >= 30
), c as (select lang, source, term, count(*)::hugeint as n from w semi join k using (lang, term) group by lang, source, term
), v as (select lang, count(*) as v, sum(total) as n from k group by lang
), g as (select distinct lang, source from d
), s as (select lang, source, sum(n) as n from c group by lang, source
), p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 5) // (coalesce(s.n, 0) + 5 * v.v) as p, 1 + 1000000000::hugeint * (k.total + 5) // (v.n + 5 * v.v) as q
  from g join k using (lang) join v using (lang) left join c using (lang, source, term) left join s using (lang, source)
), x as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), pairs as (select a.lang, a.source, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join x on x.lang = a.lang and x.source = a.source and x.item = b.source
), u as (select lang, source, 'pair' as part, item, value from pairs union all select lang, source, 'term', term, p - q from p where n > 0 and p > q
), o as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from u)
select lang, source, part, item, value::bigint as value, rank::int as rank from o where part = 'pair' or rank <= 50
"""
