"""Parsing that may fail: a source whose rules fail again and again is stored unparsed for a while instead of holding up its batch."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage
from ..sources.changes import ChangeLog

#: Failures in a row after which a source is not parsed, and for how long.
STRIKES, SECONDS = 3, 60
TIMEOUT, FAILED, PAUSED = "PARSE_TIMEOUT", "PARSE_FAILED", "PARSE_QUARANTINED"


def unparsed(events: DataFrame, reason: str) -> DataFrame:
    """events whose documents are kept as text under `_unparsed`, with `_parse_error`."""
    return events.withColumn("parsed", F.to_json(F.struct(F.lit(reason).alias("_parse_error"), F.col("parsed").alias("_unparsed"))))


class Quarantine:
    """Strikes of each source (by source type) under a set of rules, kept between batches and restarts.

    Three failures in a row, by an error or by taking longer than the limit, pause the source for a minute: its rows are stored
    unparsed. A success clears its strikes. Another name of rules starts anew.
    """

    def __init__(self, spark: SparkSession, path: str, rules: str, strikes: int = STRIKES, seconds: int = SECONDS, limit_seconds: float | None = None):
        self.spark, self.rules, self.strikes, self.seconds, self.limit_seconds = spark, rules, strikes, seconds, limit_seconds
        self.log = ChangeLog(spark, path, "source_type string, rules string, strikes int, until timestamp", ["source_type", "rules"], ["rules"], parts=1)

    def _tried(self, rows: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame | None, str]:
        """The parsed rows, written; or why there are none."""
        context = self.spark.sparkContext
        tag, ended = f"parse-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            ended.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(self.limit_seconds, stop) if self.limit_seconds else None
        context.addJobTag(tag)
        if timer:
            timer.start()
        try:
            return cut_lineage(parse(rows)), ""
        except Exception:  # whatever a rule does to its rows, they are stored
            return None, TIMEOUT if ended.is_set() else FAILED
        finally:
            context.removeJobTag(tag)
            if timer:
                timer.cancel()

    def run(self, batch: DataFrame, number: int, now: str, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The rows of a batch, parsed where they can be. All sources are parsed together; only if that fails, each by itself.

        parse keeps the columns of its rows and may set `parsed`. The same number again starts from the state before it.
        """
        at = datetime.fromisoformat(now)
        before = self.log.latest(number).filter(F.col("rules") == self.rules).withColumn("until", F.date_format("until", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        held = {r.source_type: r for r in before.collect()}  # sources that failed
        sources = [r[0] for r in batch.select("source_type").distinct().collect()]  # a text for each source of the batch
        paused = [s for s in sources if s in held and held[s].until and datetime.fromisoformat(held[s].until) > at]
        live = [s for s in sources if s not in paused]
        of = lambda some: batch.filter(F.coalesce(F.col("source_type"), F.lit("")).isin([s or "" for s in some]))
        done, changed = [unparsed(of(paused), PAUSED)] if paused else [], []
        together, _ = self._tried(of(live), parse) if live else (None, "")
        for s in [] if together is not None else live:
            rows, reason = self._tried(of([s]), parse)
            done.append(unparsed(of([s]), reason) if rows is None else rows)
            if rows is None:
                n = (held[s].strikes if s in held else 0) + 1
                changed.append((s, self.rules, 0, at + timedelta(seconds=self.seconds)) if n >= self.strikes else (s, self.rules, n, None))
            elif s in held:
                changed.append((s, self.rules, 0, None))
        if together is not None:
            done.append(together)
            changed = [(s, self.rules, 0, None) for s in live if s in held and (held[s].strikes or held[s].until)]
        stamp = [(s, r, n, until.isoformat(sep=" ") if until else None) for s, r, n, until in changed]
        state = self.spark.createDataFrame(stamp, "source_type string, rules string, strikes int, until string")
        self.log.append(number, state.withColumn("until", F.col("until").cast("timestamp")))
        out = batch.limit(0)
        for rows in done:
            out = out.unionByName(rows.select(*batch.columns))
        return out
