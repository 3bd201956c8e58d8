"""Tables that change batch by batch, kept as what each batch changed and merged when they are read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def subfolders(spark: SparkSession, path: str) -> list[str]:
    fs, p = _path(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()) if fs.exists(p) else []


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


class ChangeLog:
    """Rows by key; a batch appends the rows that it changes, whole and as they are after it, and the newest row of a key holds.

    A batch is a folder of its number, written anew if the batch comes again; it has to be made of what `latest` gives
    for the batches before it. Rows are stored by `parts` hashes of the columns `by`, so that a read of some groups, and a
    compaction, touch only their parts. Older versions of a row do no harm beside newer ones, so a compaction or a clean-up
    that ends halfway does none either. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], by: Sequence[str], parts: int = 64):
        self.spark, self.path, self.schema = spark, path, T.StructType.fromDDL(schema)
        self.keys, self.by, self.parts = list(keys), list(by), parts

    def part(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.parts)).cast("int")

    def _versions(self, kind: str) -> list[int]:
        """Numbers of what was written to the end."""
        fs, _ = _path(self.spark, self.path)
        done = lambda name: fs.exists(_path(self.spark, f"{self.path}/{kind}/{name}/_SUCCESS")[1])
        return sorted(int(n) for n in subfolders(self.spark, f"{self.path}/{kind}") if n.isdigit() and done(n))

    def _read(self, kind: str, versions: list[int]) -> list[DataFrame]:
        schema = T.StructType([*self.schema, T.StructField("part", T.IntegerType())])
        return [self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/{v}").withColumn("version", F.lit(v)) for v in versions]

    def _write(self, kind: str, number: int, rows: DataFrame) -> None:
        rows = rows.select(*self.schema.names).withColumn("part", self.part())
        rows.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/{kind}/{number}")

    def append(self, number: int, rows: DataFrame) -> None:
        self._write("changes", number, rows)

    def latest(self, before: int | None = None, among: DataFrame | None = None, where: Column | None = None) -> DataFrame:
        """The newest rows by the batches before a number, or by all; of those whose columns `by` occur in `among`; where a condition on keys holds."""
        held = [r for kind in ("base", "changes") for r in self._read(kind, [v for v in self._versions(kind) if before is None or v < before])]
        if not held:
            return self.spark.createDataFrame([], self.schema)
        rows = held[0]
        for more in held[1:]:
            rows = rows.unionByName(more)
        if where is not None:
            rows = rows.filter(where)
        if among is not None:
            groups = among.select(*self.by).distinct()
            touched = [r[0] for r in groups.select(self.part()).distinct().collect()]  # at most `parts` numbers
            rows = rows.filter(F.col("part").isin(touched))
            groups = groups.select(*[F.col(c).alias(f"of_{c}") for c in self.by])
            same = F.lit(True)
            for c in self.by:
                same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
            rows = rows.join(groups, same, "left_semi")
        others = [c for c in self.schema.names if c not in self.keys]
        if not others:
            return rows.select(*self.schema.names).distinct()
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), "version").alias("row"))
        return newest.select(*[F.col(c if c in self.keys else f"row.{c}") for c in self.schema.names])

    def compact(self, keep: int = 2, where: Column | None = None) -> int:
        """Merge all batches but the last `keep` into the parts that they touch, and delete them; with `where` only such rows are kept there. The number of parts written."""
        old = self._versions("changes")[: -keep or None]
        if not old:
            return 0
        upto = old[-1]
        changes = self._read("changes", old)
        touched = sorted({r.part for c in changes for r in c.select("part").distinct().collect()})  # at most `parts` numbers
        rows = self.latest(upto + 1, where=F.col("part").isin(touched))
        self._write("base", upto, rows if where is None else rows.filter(where))
        for v in old:
            delete_folder(self.spark, f"{self.path}/changes/{v}")
        for v in self._versions("base"):
            if v < upto:
                for p in touched:
                    delete_folder(self.spark, f"{self.path}/base/{v}/part={p}")
                if not [n for n in subfolders(self.spark, f"{self.path}/base/{v}") if n.startswith("part=")]:
                    delete_folder(self.spark, f"{self.path}/base/{v}")
        return len(touched)
