"""Shards of near-equal size by sampled splitters.

Every record has a key: 64 bits of its text's digest, then its id, then its place in the input. So equal texts lie
beside each other, and yet a text that a third of all records share can be divided anywhere. Keys are drawn with a
probability that follows a record's share of the bytes and of the rows; quantiles of the draws are splitters, and the
records are partitioned by the ranges between them. The ranges' exact sums, a row for each range, tell where the shards
end. A range that would overfill its shard is subdivided at the record where the shard is full: a record belongs to the
shard that the middle of its bytes falls into, in key order, so that a shard differs from the mean by no more than its
outermost records. What the draws are changes the ranges, never the shards.

Size is the UTF-8 bytes of the text and RECORD_BYTES for each record. Null texts are empty. Null ids come before others,
repeated rows are kept and told apart by their place only, an empty table gives no rows, and other columns are not read
by `shards` and kept by `assigned`. Fewer records than shards leave some shards empty.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import bound_batches, cut_lineage, fresh, table

SHARDS = 24
#: Bytes that a record has besides its text.
RECORD_BYTES = 8
#: Ranges: this many for each shard, more where they would hold over ROWS_IN_RANGE rows on average, MOST_RANGES at most.
RANGES_IN_SHARD, ROWS_IN_RANGE, MOST_RANGES = 16, 500_000, 49_152
#: Keys drawn for each range, on average (so that the driver holds at most some 400,000 keys of KEY_BYTES).
DRAWS = 8
KEY_BYTES = 25


def _big_endian(number: Column) -> Column:
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


def key(text: Column, record_id: Column) -> Column:
    """Binary key of KEY_BYTES bytes, in the order of the text's digest, of the ids (null first) and of the rows' places."""
    known = F.when(record_id.isNull(), F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("01")))
    of_id = _big_endian(F.coalesce(record_id, F.lit(0)).cast("long").bitwiseXOR(F.lit(-(2**63))))
    return F.concat(F.unhex(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 16)), known, of_id, _big_endian(F.monotonically_increasing_id()))


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and key of every row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(RECORD_BYTES)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        key(F.col("text"), F.col("doc_id")).alias("key"),
    )


def _keys(column: pa.Array) -> np.ndarray:
    """Keys as fixed-width byte strings, which compare as the binary values do: all are equally long."""
    fixed = column.cast(pa.binary(KEY_BYTES))
    return np.frombuffer(fixed.buffers()[1], f"S{KEY_BYTES}")[fixed.offset : fixed.offset + len(fixed)]


def splitters(rows: DataFrame, n: int, total: int, ranges: int) -> np.ndarray:
    """Quantiles of keys that are drawn by their records' share of bytes and rows; the same rows give the same ones."""
    share = (F.col("size") / F.lit(total) + F.lit(1 / n)) / 2
    uniform = F.pmod(F.xxhash64("key"), F.lit(1 << 40)) / F.lit(1 << 40)
    drawn = rows.filter(uniform < share * F.lit(DRAWS * ranges)).select("key").toArrow().column("key").combine_chunks()
    at = np.sort(_keys(drawn)) if len(drawn) else np.array([], f"S{KEY_BYTES}")
    return np.unique(at[DRAWS::DRAWS])


def _ranged(rows: DataFrame, edges: np.ndarray, name: str) -> DataFrame:
    """rows and column `name`: how many of the sorted edges don't lie above a row's key."""

    def run(batches):
        for batch in batches:
            at = np.searchsorted(edges, _keys(batch.column(batch.schema.get_field_index("key"))), side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=[*batch.schema.names, name])

    bound_batches(rows)
    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField(name, T.IntegerType())]))


def _shard_of(before: Column, size: Column, total: int, n: int) -> Column:
    """Shard that the middle of the bytes [before, before + size) falls into."""
    return F.least(F.lit(n - 1), F.floor(F.try_divide((2 * before + size).cast("decimal(38,0)") * n, F.lit(2 * total).cast("decimal(20,0)")))).cast("int")


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table with a row for each range or shard: at most MOST_RANGES rows of numbers, so it may be broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def placed(docs: DataFrame, n: int = SHARDS, ranges: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, key, shard and slot (from 0, in key order, without gaps in a shard) of every row of docs.

    The number of ranges can be given; it has no influence on the result.
    """
    spark = docs.sparkSession
    rows = cut_lineage(records(docs))
    n_rows, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    if not n_rows:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    ranges = ranges or min(MOST_RANGES, max(n * RANGES_IN_SHARD, n_rows // ROWS_IN_RANGE))
    ranged = cut_lineage(_ranged(rows, splitters(rows, n_rows, total, ranges), "range"))
    offsets, bytes_before, rows_before = [], 0, 0
    for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).orderBy("range").collect():  # a row for each range
        offsets.append((r.range, bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + r.bytes, rows_before + r.n
    inside = Window.partitionBy("range").orderBy("key")
    before = F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    at = F.col("rows_before") + F.row_number().over(inside) - 1
    found = ranged.join(_small(spark, offsets, "range int, bytes_before long, rows_before long"), "range")
    found = cut_lineage(found.select("doc_id", "size", "text_crc32", "key", _shard_of(before, F.col("size"), total, n).alias("shard"), at.alias("at")))
    firsts, first = [], 0
    for r in found.groupBy("shard").count().orderBy("shard").collect():  # a row for each shard
        firsts.append((r[0], first))
        first += r[1]
    return found.join(_small(spark, firsts, "shard int, first long"), "shard").select("doc_id", "size", "text_crc32", "key", "shard", (F.col("at") - F.col("first")).alias("slot"))


def cuts(docs: DataFrame, n: int = SHARDS) -> Callable[[DataFrame], DataFrame]:
    """What adds the column shard to docs, all other columns kept, in one pass over them and without a shuffle.

    The function holds the smallest key of each shard. Rows that are repeated with id and text are told apart by their
    place, so it has to get the table that the cuts were made of.
    """
    least = {r[0]: bytes(r[1]) for r in placed(docs, n).groupBy("shard").agg(F.min("key")).collect()}
    shards = sorted(least)
    edges = np.array([least[s] for s in shards[1:]], f"S{KEY_BYTES}")

    def assigned(docs: DataFrame) -> DataFrame:
        plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # whatever the names are
        lower = [c.lower() for c in docs.columns]
        text, record_id = (F.col(f"c{lower.index(c)}") for c in ("text", "doc_id"))
        out = _ranged(plain.withColumn("key", key(text, record_id)), edges, "at").drop("key")
        number = F.element_at(F.array(*[F.lit(s) for s in shards]), F.col("at") + 1) if shards else F.lit(0)
        return out.withColumn("at", number).toDF(*docs.columns, *fresh(docs, "shard"))

    return assigned


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = placed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _checksum_table() -> list[int]:
    """What the CRC-32 polynomial makes of each byte."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    return table


#: DuckDB: the same law over one sorted table; the checksum byte by byte.
SQL = f"""
with d as (select doc_id, coalesce(text, '') as text from documents
), s as (select doc_id, strlen(text)::bigint + 8 as size, substr(md5(text), 1, 16) as digest,
    list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint) as bytes from d
), o as (select doc_id, size, digest,
    xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, b: xor(c >> 8, ({_checksum_table()}::bigint[])[(xor(c, b) & 255) + 1])), 4294967295) as text_crc32,
    2 * sum(size) over (order by digest, doc_id nulls first rows unbounded preceding) - size as twice, sum(size) over () as total from s
), p as (select *, least(23, twice * 24 // (2 * total))::int as shard from o)
select doc_id, size, text_crc32, 'bytes' as law, shard,
  row_number() over (partition by shard order by digest, doc_id nulls first) - 1 as slot, null::int as grown_shard from p
"""
