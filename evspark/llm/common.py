"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage, shared_folder  # noqa: F401
from ..functions.sizes import if_small  # noqa: F401

#: Bytes of text that a Python task works on at once (a longer text is worked on alone).
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch between Spark and Python tasks.
BATCH_BYTES = 4 << 20
#: Largest id list, in rows of at most 16 bytes, that is broadcast (so 16 MB); beyond it the same join shuffles.
BROADCAST_ROWS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Names for columns that are joined to df: each as it is, or with underscores before it if df has one of that name, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """doc_id, text and y of labelled documents: at most `sample` pairs of id and label, those of the smallest hashes of doc_id.

    The same tables give the same rows in every run: of an id that has several texts the one of smallest hash is taken.
    Null ids and labels are left out.
    """
    some = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("labelled_id"), F.col(label).cast("int").alias("y")).distinct()
    some = some.orderBy(F.xxhash64("labelled_id"), "labelled_id", "y").limit(sample)
    # The bound makes the broadcast small: an id and a label for each row.
    texts = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("labelled_id"))
    return texts.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "y")


def bound_batches(df: DataFrame) -> None:
    """Let Arrow batches hold BATCH_BYTES, since rows may be long, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, BATCH_BYTES)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Consecutive parts of a batch of at most `limit` bytes of text, or one row; null text reads as ''."""
    i = batch.schema.get_field_index(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False))
    lo, n = 0, batch.num_rows
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        part = batch.slice(lo, hi - lo)
        yield part, [t or "" for t in part.column(i).to_pylist()]
        lo = hi


def map_texts(
    df: DataFrame, keep: list[str], schema: str, score: Callable[[list[str]], list[pa.Array]], column: str = "text"
) -> DataFrame:
    """Columns `keep` of df and those that `score` makes of its texts, slice by slice; `schema` is DDL of the latter.

    `score` runs in Python tasks; it is made there by calling the given factory once per task.
    """
    from pyspark.sql import types as T

    made = T.StructType.fromDDL(schema)
    out = T.StructType([df.schema[c] for c in keep] + list(made))
    names = [f.name for f in out]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = score()
        for batch in batches:
            for part, texts in slices(batch, column):
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in keep] + work(texts), names=names)
        pa.default_memory_pool().release_unused()  # the worker may idle while others need the memory

    bound_batches(df)
    return df.select(*dict.fromkeys([*keep, column])).mapInArrow(run, out)


def share(spark: SparkSession, value):
    """Broadcast of a value whose size doesn't depend on the input (a vocabulary, a model)."""
    return spark.sparkContext.broadcast(value)
