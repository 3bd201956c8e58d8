"""Stored events: Parquet partitioned by tenant and day of arrival, with idempotent appends, deletes by day and copies that are verified."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import event_time
from ..functions.lineage import cut_lineage
from ..functions.security import daily_id
from .envelope import SCHEMA, cleaned

_DAY = "yyyy-MM-dd"
_DAY_FIELD = T.StructField("day", T.StringType())
#: Columns as stored: a given schema keeps days text, however they look.
STORED = T.StructType([*SCHEMA, T.StructField("ts", T.TimestampType()), _DAY_FIELD])


def day_of(c: str = "received_at") -> Column:
    return F.date_format(c, _DAY)


def with_ids(events: DataFrame, batch: str) -> DataFrame:
    """Events with ids for those that have none, made of the row and the name of the batch, so that a replayed batch gets the same ones.

    Equal rows of one batch are told apart by number. They are counted first, so that a row that comes very often is one row in the shuffle.
    """
    have = events.filter(F.col("id").isNotNull())
    lack = events.filter(F.col("id").isNull()).drop("id")
    n = lack.groupBy(*lack.columns).agg(F.count(F.lit(1)).alias("_n"))
    each = n.select(*lack.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_k")).drop("_n")
    text = F.to_json(F.struct(*lack.columns), {"ignoreNullFields": "false"})
    made = each.withColumn("id", daily_id(F.lit(batch), text, F.col("_k").cast("string")))
    return have.select(*events.columns).unionByName(made.select(*events.columns))


@dataclass(frozen=True)
class Deleted:
    """What a delete did: rows of each source type that went, days dropped whole, days rewritten, and whether days were left for another run."""

    by_source: dict[str, int]
    dropped: list[str]
    rewritten: list[str]
    truncated: bool = False

    @property
    def rows(self) -> int:
        return sum(self.by_source.values())


class EventTable:
    """A folder of events. Every read and write is for one tenant, but for whole days that go for all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, *parts: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _exists(self) -> bool:
        fs, path = self._folder()
        return fs.exists(path)

    def stored(self, tenant: str | None = None) -> DataFrame:
        """All columns, with the partition columns tenant_id and day."""
        rows = self.spark.read.schema(STORED).parquet(self.path)
        return rows if tenant is None else rows.filter(F.col("tenant_id") == tenant)

    def read(self, tenant: str) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], SCHEMA)
        return self.stored(tenant).select(*SCHEMA.names)

    def append(self, events: DataFrame, tenant: str, now: str | None = None, batch: str | None = None, days: list[str] | None = None, whole: bool = False) -> DataFrame:
        """Store the rows that are new by (id, received_at); returns the ones that were rejected, with the reason.

        A row without a time of arrival gets now, one without an id gets one made of its content and the batch's name, so that
        the same batch with the same `now` can be stored again without harm. Only the days that arrive are read for the
        comparison: those given, else the ones found in the rows. With `whole` nothing is stored if a row is rejected. The stored
        `ts` column is the event time, so that searches by time skip row groups.
        """
        at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
        checked = cleaned(events.withColumn("tenant_id", F.coalesce("tenant_id", F.lit(tenant))))
        checked = checked.withColumn("rejected", F.coalesce("rejected", F.when(F.col("tenant_id") != tenant, F.lit("another tenant"))))
        bad = checked.filter(F.col("rejected").isNotNull())
        if whole and not bad.isEmpty():
            return bad
        good = checked.filter(F.col("rejected").isNull()).drop("rejected").withColumn("received_at", F.coalesce("received_at", at))
        good = with_ids(good, batch or uuid.uuid4().hex).dropDuplicates(["id", "received_at"])
        new = good.withColumn("day", day_of()).withColumn("ts", event_time())
        if self._exists():
            if days is None:
                days = [r.day for r in new.select("day").distinct().collect()]  # a text for each day that arrives
            stored = self.stored(tenant).filter(F.col("day").isin(days)).select("day", "id", "received_at")
            new = new.join(stored, ["day", "id", "received_at"], "left_anti").select(*new.columns)
        new.write.mode("append").option("compression", "zstd").partitionBy("tenant_id", "day").parquet(self.path)
        return bad

    def rewrite(self, kept: DataFrame, tenant: str, to: str) -> EventTable:
        """A new version of the table in another folder, with only what is kept of this tenant; `delete` changes a table in place."""
        rest = self.stored().filter(F.col("tenant_id") != tenant)
        own = kept.withColumn("day", day_of()).withColumn("ts", event_time()).select(*rest.columns)
        rest.unionByName(own).write.option("compression", "zstd").partitionBy("tenant_id", "day").parquet(to)
        return EventTable(self.spark, to)

    def _drop(self, tenant: str, day: str) -> None:
        fs, path = self._folder(f"tenant_id={tenant}", f"day={day}")
        fs.delete(path, True)

    def delete(self, tenant: str, gone: Column, upto: str, most_days: int | None = None) -> Deleted:
        """Delete the tenant's rows where `gone` holds, which may be on days up to `upto` (YYYY-MM-DD) only.

        Later days are not read. Days that lose all their rows are dropped as folders, those that lose some are rewritten, others and
        other tenants' are not touched. At most `most_days` days, the oldest ones, are worked on in a run.

        One writer at a time is meant: there is no lock. Still, a day that got rows since it was counted is left alone for the next
        run, and days are rewritten before others are dropped, so that a run that ends halfway is finished by the next.
        """
        if not self._exists():
            return Deleted({}, [], [])
        old = self.stored(tenant).filter(F.col("day") <= upto).withColumn("_gone", F.coalesce(gone, F.lit(False)))
        counts = old.groupBy("day", "source_type").agg(F.count_if("_gone").alias("gone"), F.count_if(~F.col("_gone")).alias("kept")).collect()  # a row for each day and source
        days: dict[str, list] = {}
        for r in counts:
            days.setdefault(r.day, []).append(r)
        touched = sorted(d for d, rows in days.items() if any(r.gone for r in rows))
        now = touched[:most_days] if most_days is not None else touched
        dropped = [d for d in now if not any(r.kept for r in days[d])]
        rewritten = [d for d in now if d not in set(dropped)]
        if rewritten:
            kept = cut_lineage(old.filter(F.col("day").isin(rewritten) & ~F.col("_gone")).drop("_gone"))
        counted = {d: sum(r.gone + r.kept for r in days[d]) for d in now}
        there = {r.day: r["count"] for r in self.stored(tenant).filter(F.col("day").isin(now)).groupBy("day").count().collect()} if now else {}
        now, left = [d for d in now if there.get(d) == counted[d]], [d for d in now if there.get(d) != counted[d]]
        dropped, rewritten = [d for d in dropped if d in now], [d for d in rewritten if d in now]
        if rewritten:
            kept = kept.filter(F.col("day").isin(rewritten)) if left else kept
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("tenant_id", "day").parquet(self.path)
        for d in dropped:
            self._drop(tenant, d)
        by_source: dict[str, int] = {}
        for d in now:
            for r in days[d]:
                if r.gone:
                    by_source[r.source_type] = by_source.get(r.source_type, 0) + r.gone
        return Deleted(by_source, dropped, rewritten, len(now) < len(touched))

    def delete_before(self, tenant: str, cutoff: str) -> Deleted:
        """Delete the tenant's rows that arrived before the cutoff (a UTC time as text)."""
        return self.delete(tenant, F.col("received_at") < F.lit(cutoff).cast("timestamp"), cutoff[:10])

    def delete_expired(self, tenant: str, default_days: int | None, overrides: dict[str, int | None], now: str, most_days: int | None = None) -> Deleted:
        """Delete what is older than its source type's days of retention, else than the default; None keeps for ever."""
        kept_days = F.lit(default_days).cast("int")
        for source, days in overrides.items():
            kept_days = F.when(F.col("source_type") == source, F.lit(days).cast("int")).otherwise(kept_days)
        shortest = min((d for d in [default_days, *overrides.values()] if d is not None), default=None)
        if shortest is None:
            return Deleted({}, [], [])
        at = F.lit(now).cast("timestamp")
        upto = self.spark.range(1).select(F.date_format(at - F.make_dt_interval(F.lit(shortest)), _DAY)).first()[0]
        return self.delete(tenant, F.col("received_at") < at - F.make_dt_interval(kept_days), upto, most_days)

    def drop_days_before(self, day: str) -> list[str]:
        """Drop the folders of all tenants' days before this one (YYYY-MM-DD); returns the days that went, oldest first. No row is read."""
        fs, path = self._folder()
        if not fs.exists(path):
            return []
        gone = set()
        for tenant in fs.listStatus(path):
            if tenant.isDirectory() and tenant.getPath().getName().startswith("tenant_id="):
                for f in fs.listStatus(tenant.getPath()):
                    name = f.getPath().getName()
                    if name.startswith("day=") and name[4:] < day:
                        fs.delete(f.getPath(), True)
                        gone.add(name[4:])
        return sorted(gone)


def safe_drop_day(policies: DataFrame, now: str) -> DataFrame:
    """One row: the day before which no tenant needs anything, or null with the reason.

    policies: tenant_id, auto_purge, default_days and overrides (array of days, with null for what is kept for ever).
    """
    days = F.greatest("default_days", F.coalesce(F.array_max(F.coalesce("overrides", F.array().cast("array<int>"))), F.lit(0)))
    p = policies.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.coalesce("auto_purge", F.lit(False))).alias("off"),
        F.count_if(F.coalesce(F.exists("overrides", lambda d: d.isNull()), F.lit(False)) | F.col("default_days").isNull()).alias("forever"),
        F.max(days).alias("days"),
    )
    reason = F.when(F.col("n") == 0, "no tenants").when(F.col("off") > 0, "automatic purge is off for a tenant").when(F.col("forever") > 0, "a tenant keeps something for ever")
    day = F.date_format(F.lit(now).cast("timestamp") - F.make_dt_interval(F.col("days")), _DAY)
    return p.select(F.when(reason.isNull(), day).alias("day"), reason.alias("reason"))


_COMPARED = ("source_type", "collector_id", "event_time", "raw", "parsed")


def copied(source: DataFrame, target: EventTable, tenant: str) -> DataFrame:
    """Copy the events that the target lacks; returns those that don't read back equal (none, if all is well)."""
    missing = source.join(target.read(tenant).select("id", "received_at"), ["id", "received_at"], "left_anti").select(*source.columns)
    target.append(missing, tenant)
    back = target.read(tenant).select("id", "received_at", F.struct(*_COMPARED).alias("stored"))
    both = source.join(back, ["id", "received_at"], "left")
    return both.filter(~F.col("stored").eqNullSafe(F.struct(*_COMPARED))).select(*source.columns)


def day_digests(events: DataFrame) -> DataFrame:
    """Rows of each day and a digest that doesn't depend on their order, for backups that copy only what changed."""
    return events.groupBy(day_of().alias("day")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*[F.col(c) for c in SCHEMA.names])).alias("digest"))


#: Times in backups, to the microsecond.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
#: Days that are still receiving events: the last ones are written anew by every backup.
REFRESH_DAYS = 2


def _keys(spark: SparkSession, secret: str, days: list[str]) -> DataFrame:
    """The key made of a secret, a row for each day: a table, since values in an expression show in plans and logs."""
    key = hashlib.sha256(secret.encode()).digest()
    return F.broadcast(spark.createDataFrame([(d, key) for d in days], "day string, _key binary"))


def backup(events: DataFrame, folder: str, manifest: DataFrame | None = None, secret: str | None = None, now_day: str | None = None) -> DataFrame:
    """Write the days whose digest isn't in the manifest (day, n, digest, part) as gzipped JSON lines; returns the new manifest.

    `part` is the folder below `folder` that a day's newest copy is in. With a secret each line is encrypted (AES-GCM, 256 bits). With
    now_day (YYYY-MM-DD) the REFRESH_DAYS days up to it, and later ones, are written in any case.
    """
    part = uuid.uuid4().hex
    now = day_digests(events)
    before = None if manifest is None else manifest.select("day", "n", "digest", "part")
    named = now.withColumn("part", F.lit(None).cast("string")) if before is None else now.join(before, ["day", "n", "digest"], "left")
    if now_day is not None:
        named = named.withColumn("part", F.when(F.col("day") <= F.date_sub(F.lit(now_day).cast("date"), REFRESH_DAYS).cast("string"), F.col("part")))
    named = cut_lineage(named.withColumn("part", F.coalesce("part", F.lit(part))))  # a row for each day
    rows = events.withColumn("day", day_of()).join(named.filter(F.col("part") == part).select("day"), "day", "left_semi")
    if secret is not None:
        # One line each: base64 may put line breaks into long values.
        line = F.regexp_replace(F.base64(F.aes_encrypt(F.to_json(F.struct(*SCHEMA.names), _TIMES).cast("binary"), F.col("_key"), F.lit("GCM"))), r"\s", "")
        written = [r.day for r in named.filter(F.col("part") == part).select("day").collect()]
        rows.join(_keys(events.sparkSession, secret, written), "day").select(line.alias("value"), "day").write.option("compression", "gzip").partitionBy("day").text(f"{folder}/{part}")
        return named
    rows.select(*SCHEMA.names, "day").write.options(**_TIMES).option("compression", "gzip").partitionBy("day").json(f"{folder}/{part}")
    return named


def restored(spark: SparkSession, folder: str, manifest: DataFrame, secret: str | None = None) -> DataFrame:
    """The events of a backup, each day from the part that the manifest names. A line that the secret doesn't open, or that was changed, is no event."""
    parts = [r.part for r in manifest.select("part").distinct().collect()]  # one for each run that wrote something
    out = spark.createDataFrame([], SCHEMA)
    for part in parts:
        of = [r.day for r in manifest.filter(F.col("part") == part).select("day").collect()]
        if secret is None:
            rows = spark.read.schema(T.StructType([*SCHEMA, _DAY_FIELD])).options(**_TIMES).json(f"{folder}/{part}")
        else:
            lines = spark.read.schema(T.StructType([T.StructField("value", T.StringType()), _DAY_FIELD])).text(f"{folder}/{part}").join(_keys(spark, secret, of), "day")
            plain = F.try_aes_decrypt(F.unbase64("value"), F.col("_key"), F.lit("GCM")).cast("string")
            rows = lines.select("day", F.from_json(plain, SCHEMA, _TIMES).alias("e")).filter(F.col("e.id").isNotNull()).select("day", "e.*")
        out = out.unionByName(rows.filter(F.col("day").isin(of)).select(*SCHEMA.names))
    return out


def damaged(spark: SparkSession, folder: str, manifest: DataFrame, secret: str | None = None) -> DataFrame:
    """Days of the manifest whose backup doesn't have its count and digest (none, if all is well)."""
    found = day_digests(restored(spark, folder, manifest, secret))
    return manifest.select("day", "n", "digest").join(found, ["day", "n", "digest"], "left_anti")
