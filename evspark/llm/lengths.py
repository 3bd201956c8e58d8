"""Exact histogram of encoded lengths, and what it answers for every context limit.

One pass encodes each document and partial aggregation leaves a row for each length, however many
documents there are. Suffix sums over the lengths then give, for a limit L: documents and tokens at or
above L, and the tokens left when every document is cut at L. They are taken in two levels, within blocks
of SPAN lengths and over the blocks' totals, so that no task holds all lengths.

Null and empty texts have length 0 and are counted. An empty table gives an empty histogram. Repeated rows
count each time. Columns other than the text and the grouping columns are not read.
"""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import default_vocabulary, loaded
from .common import cut_lineage, map_texts, share, table

#: Lengths in a block of the suffix sums.
SPAN = 4096


def token_lengths(docs: DataFrame, vocabulary: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns `keep` and n_tokens of the text under a byte-level BPE vocabulary."""
    held = share(docs.sparkSession, Path(vocabulary or default_vocabulary()).read_bytes())

    def score():
        bpe = loaded(held.value)
        return lambda texts: [pa.array([len(x) // 4 for x in bpe.encode(texts)], pa.int64())]

    return map_texts(docs, list(keep), "n_tokens long", score)


def histogram(lengths: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Columns `by`, n_tokens and n_docs from a column n_tokens; null lengths count as 0."""
    n = F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")
    return lengths.groupBy(*by, n).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """For each length: docs_ge, tokens_ge (at or above it), docs_le, total_docs, total_tokens, truncated_tokens (each document cut at it)."""
    hist = hist.withColumn("block", F.floor(F.col("n_tokens") / SPAN))
    whole = Window.partitionBy(*by)
    after = whole.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = hist.groupBy(*by, "block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    blocks = blocks.select(
        *[F.col(c).alias(f"of_{i}") for i, c in enumerate(by)],
        F.col("block").alias("of_block"),
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
        F.sum("d").over(whole).alias("total_docs"),
        F.sum("t").over(whole).alias("total_tokens"),
    )
    same = F.col("block") == F.col("of_block")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"of_{i}"))
    inside = Window.partitionBy(*by, "block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = hist.join(blocks, same).select(
        *by,
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(inside) + F.col("d_after")).alias("docs_ge"),
        (F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside) + F.col("t_after")).alias("tokens_ge"),
        "total_docs",
        "total_tokens",
    )
    return out.select(
        *by,
        "n_tokens",
        "n_docs",
        "docs_ge",
        "tokens_ge",
        (F.col("total_docs") - F.col("docs_ge") + F.col("n_docs")).alias("docs_le"),
        "total_docs",
        "total_tokens",
        (F.col("total_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_tokens"),
    )


def quantile(sums: DataFrame, q: float | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """The smallest length that at least a share q of the documents don't exceed (nearest rank)."""
    return sums.filter(F.col("docs_le") >= F.lit(q) * F.col("total_docs")).groupBy(*by).agg(F.min("n_tokens").alias("quantile"))


def totals_at(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For each limit of a given list: documents longer than it, and all tokens when documents are cut at it."""
    one = sums.agg(
        F.max("total_docs").alias("total_docs"),
        *[F.min(F.when(F.col("n_tokens") >= x, F.struct("n_tokens", "docs_ge", "tokens_ge"))).alias(f"at_{x}") for x in limits],
        *[F.min(F.when(F.col("n_tokens") > x, F.struct("n_tokens", "docs_ge"))).alias(f"over_{x}") for x in limits],
        F.max("total_tokens").alias("total_tokens"),
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(x).cast("long").alias("context_limit"),
                F.coalesce(F.col(f"over_{x}.docs_ge"), F.lit(0)).alias("n_longer"),
                (F.col("total_tokens") - F.coalesce(F.col(f"at_{x}.tokens_ge"), F.lit(0)) + x * F.coalesce(F.col(f"at_{x}.docs_ge"), F.lit(0))).alias("truncated_tokens"),
            )
            for x in limits
        ]
    )
    return one.filter(F.col("total_docs").isNotNull()).select(F.inline(rows))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(cut_lineage(histogram(token_lengths(table(spark, sf_dir, "documents")))))  # read twice
