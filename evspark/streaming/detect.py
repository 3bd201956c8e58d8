"""Structured Streaming: deduplicated ingest, indicator matching, and detection runs on every micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.fields import event_time
from ..functions.lineage import cut_lineage
from ..operators import cycle, ioc
from ..operators.rulesets import Detection
from ..sources.changes import ChangeLog, delete_folder, subfolders
from ..sources.tables import EventTable
from .panes import Panes
from .quarantine import Quarantine


def deduplicated(events: DataFrame, within: str = "1 hour") -> DataFrame:
    """Drop repeats of (id, received_at) that arrive within the watermark; rows that are later than it are left out."""
    return events.withWatermark("received_at", within).dropDuplicatesWithinWatermark(["id", "received_at"])


def arrival(spark: SparkSession, checkpoint: str, number: int) -> str:
    """The time that a batch first arrived, kept beside the checkpoint, so that a replay of the batch has it too. Those of the last two batches stay."""
    folder = f"{checkpoint}-arrivals/{number}"
    spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")).write.mode("ignore").parquet(folder)
    kept = spark.read.schema("at string").parquet(folder).first()
    if kept is None:  # a failed write left an empty folder
        spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")).write.mode("overwrite").parquet(folder)
        kept = spark.read.schema("at string").parquet(folder).first()
    for old in subfolders(spark, f"{checkpoint}-arrivals"):
        if old.isdigit() and int(old) < number - 1:
            delete_folder(spark, f"{checkpoint}-arrivals/{old}")
    return kept.at


def ingest(events: DataFrame, path: str, checkpoint: str, tenant: str, **trigger) -> StreamingQuery:
    """Append a stream of events to a table; each batch stores only what is new, so repeats and replays do no harm and late events are kept.

    Rows without an id or a time of arrival get both from their batch's number and first arrival.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        EventTable(spark, path).append(batch, tenant, now=arrival(spark, checkpoint, number), batch=f"{checkpoint}#{number}")

    return each_batch(events, store, checkpoint, **trigger)


def indicator_alerts(events: DataFrame, indicators: DataFrame, alerts: ChangeLog, checkpoint: str, **trigger) -> StreamingQuery:
    """Scan a stream for indicators; each batch writes the alerts that its hits move or make, so nothing is missed or counted twice."""

    def scan(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = cut_lineage(ioc.matched(batch, indicators))
        before = alerts.latest(number, found.select(ioc.group_key(F.col("key")).alias("group_key")))
        alerts.append(number, ioc.changed(before, found, arrival(spark, checkpoint, number)))

    return each_batch(events, scan, checkpoint, **trigger)


def rule_alerts(events: DataFrame, rules: Sequence[Detection], panes: Panes, alerts: ChangeLog, checkpoint: str, **trigger) -> StreamingQuery:
    """All rules over a stream: a batch's events correct their panes, the panes give the hits, and these move or make alerts.

    What is read in a batch are its events, the panes of the rules' windows and the alerts of the groups hit. The rules' windows end
    with the minute of the batch's arrival.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = arrival(spark, checkpoint, number)[:16] + ":00"
        panes.add(number, batch)
        found = cut_lineage(panes.hits(now, number + 1))
        changed = cycle.changes(alerts.latest(number, found.select("group_key")), found, now)
        alerts.append(number, changed.filter(F.col("id").isNotNull()).drop("change"))

    return each_batch(events, run, checkpoint, **trigger)


def parsed_batches(events: DataFrame, parse: Callable[[DataFrame], DataFrame], quarantine: Quarantine, store: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Parse a stream and store every batch, what can't be parsed as it came; store(rows, number) may be called with the same batch again."""

    def run(batch: DataFrame, number: int) -> None:
        store(quarantine.run(batch, number, arrival(batch.sparkSession, checkpoint, number), parse), number)

    return each_batch(events, run, checkpoint, **trigger)


def indicator_hits(events: DataFrame, indicators: DataFrame) -> DataFrame:
    """Stream-static join: each event with the indicators it has."""
    return ioc.matches(events, indicators)


def windowed_counts(events: DataFrame, group: Column, window: str = "10 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts of a group in sliding windows of event time, as a stream; later events than `late` are left out."""
    rows = events.withColumn("at", event_time()).withWatermark("at", late)
    found = rows.groupBy(F.window("at", window, slide), group.alias("group_key")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "group_key", "n")


def each_batch(events: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Call run(batch, number) for every micro-batch; a number that comes again after a failure is the same batch."""
    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "60 seconds"})).start()
