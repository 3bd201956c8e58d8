"""Event tables: appends that read only arriving days, stable ids, deletes by day, backups; and streams over them."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evspark.operators import ioc
from evspark.sources.envelope import SCHEMA
from evspark.sources.tables import EventTable, backup, copied, damaged, restored, with_ids
from evspark.streaming import detect

T0 = datetime(2026, 10, 1)


def rows(spark, days, tenant="a", per_day=3, with_id=True):
    data = []
    for d in days:
        for i in range(per_day):
            at = T0 + timedelta(days=d, hours=i)
            data.append((f"{tenant}-{d}-{i}" if with_id else None, tenant, ["syslog", "mac", "router"][i % 3], f"c{i}", at if with_id else None, at, f"line {d} {i}", '{"n":%d}' % d))
    return spark.createDataFrame(data, SCHEMA)


def stored(table, tenant="a"):
    return sorted((r.id, r.received_at) for r in table.read(tenant).collect())


def folders(path, tenant="a"):
    return sorted(f[4:] for f in os.listdir(f"{path}/tenant_id={tenant}"))


@pytest.fixture
def table(spark, tmp_path):
    t = EventTable(spark, str(tmp_path / "events"))
    t.append(rows(spark, range(5)), "a")
    t.append(rows(spark, range(5), "b"), "b")
    return t


def test_append_reads_arriving_days_only(spark, table, monkeypatch):
    """The scan of what is stored is limited to the days of the batch by its partition filter."""
    plans = []
    real = EventTable.stored

    def spy(self, tenant=None):
        df = real(self, tenant)
        plans.append(df)
        return df

    monkeypatch.setattr(EventTable, "stored", spy)
    table.append(rows(spark, [3, 9]), "a")
    assert len(stored(table)) == 18 and folders(table.path)[-1] == "2026-10-10"
    plan = real(table, "a").filter(F.col("day").isin(["2026-10-04", "2026-10-10"]))._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("PushedFilters")[0]
    assert "tenant_id" in filters and "2026-10-04" in filters
    assert plans


def test_stable_ids(spark, table):
    """A batch without ids that is stored again changes nothing; equal rows of a batch are kept apart."""
    lines = rows(spark, [0], per_day=2, with_id=False)
    batch = lines.union(lines).union(rows(spark, [7]))
    before = len(stored(table))
    for _ in range(2):
        table.append(batch, "a", now="2026-10-08 05:00:00", batch="n1")
        assert len(stored(table)) == before + 4 + 3
    table.append(batch, "a", now="2026-10-08 06:00:00", batch="n2")
    assert len(stored(table)) == before + 8 + 3
    ids = [r.id for r in with_ids(lines.union(lines), "x").collect()]
    assert len(set(ids)) == 4 and ids and all(len(i) == 36 for i in ids)


def test_whole_batches(spark, table):
    bad = rows(spark, [8]).union(spark.createDataFrame([("x", "b", "syslog", None, T0, None, "r", "{}")], SCHEMA))
    before = stored(table)
    assert [r.rejected for r in table.append(bad, "a", whole=True).collect()] == ["another tenant"] and stored(table) == before
    assert table.append(bad, "a").count() == 1 and len(stored(table)) == len(before) + 3


def test_delete_before(spark, table):
    other = stored(table, "b")
    untouched = os.listdir(f"{table.path}/tenant_id=a/day=2026-10-05")
    done = table.delete_before("a", "2026-10-03 01:00:00")
    assert (done.rows, done.dropped, done.rewritten, done.truncated) == (7, ["2026-10-01", "2026-10-02"], ["2026-10-03"], False)
    assert [i for i, _ in stored(table)] == [f"a-{d}-{i}" for d in range(5) for i in range(3) if (d, i) >= (2, 1)] and stored(table, "b") == other
    assert folders(table.path) == ["2026-10-03", "2026-10-04", "2026-10-05"] and os.listdir(f"{table.path}/tenant_id=a/day=2026-10-05") == untouched
    assert table.delete_before("a", "2026-10-03 01:00:00").rows == 0


def test_delete_expired(spark, table):
    """Brute force by each row's own retention, in runs of one day; rows of exactly the age stay."""
    now, policy = datetime(2026, 10, 6), {"mac": None, "router": 3}
    keep = [r.id for r in table.read("a").collect() if (days := policy.get(r.source_type, 4)) is None or r.received_at >= now - timedelta(days=days)]
    first = table.delete_expired("a", 4, policy, str(now), most_days=1)
    assert first.truncated and not set(first.by_source) & {"mac"}
    while table.delete_expired("a", 4, policy, str(now), most_days=1).truncated:
        pass
    assert [i for i, _ in stored(table)] == sorted(keep) and len(keep) < 15
    assert table.delete_expired("b", None, {}, str(now)).rows == 0 and len(stored(table, "b")) == 15


def test_drop_days(spark, table):
    assert table.drop_days_before("2026-10-03") == ["2026-10-01", "2026-10-02"]
    assert folders(table.path) == folders(table.path, "b") == ["2026-10-03", "2026-10-04", "2026-10-05"]
    empty = EventTable(spark, table.path + "-none")
    assert empty.drop_days_before("2026-10-03") == [] and empty.delete_before("a", "2026-10-03 00:00:00").rows == 0 and empty.read("a").count() == 0


def test_copy_and_backup(spark, table, tmp_path):
    target = EventTable(spark, str(tmp_path / "copy"))
    assert copied(table.read("a"), target, "a").count() == 0 and stored(target) == stored(table)
    folder = str(tmp_path / "backup")
    one = backup(table.read("a"), folder)
    assert damaged(spark, folder, one).count() == 0
    table.append(rows(spark, [4, 6], per_day=5), "a")
    two = backup(table.read("a"), folder, one)
    assert len({r.part for r in two.collect()}) == 2 and damaged(spark, folder, two).count() == 0
    columns = SCHEMA.names
    assert sorted(map(tuple, restored(spark, folder, two).select(columns).collect())) == sorted(map(tuple, table.read("a").select(columns).collect()))
    assert damaged(spark, folder, two.withColumn("digest", F.col("digest") + 1)).count() == two.count()


def test_streams(spark, tmp_path):
    """A stream without ids, replayed from its source with a new checkpoint under the same name."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows(spark, [0], with_id=False).write.json(f"{source}/1")
    read = lambda: spark.readStream.schema(SCHEMA).json(f"{source}/*")
    ck = str(tmp_path / "ck")
    detect.ingest(read(), out, ck, "a", availableNow=True).awaitTermination()
    first = stored(EventTable(spark, out))
    assert len(first) == 3
    os.rename(ck, ck + "-lost")  # the progress is lost, so the same batch comes again
    detect.ingest(read(), out, ck, "a", availableNow=True).awaitTermination()
    assert stored(EventTable(spark, out)) == first
