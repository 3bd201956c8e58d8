from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from evspark.functions import predicates as P
from evspark.functions.fields import field, path_text
from evspark.operators.match import by_capture, by_field, match_groups
from evspark.operators.search import Search, frequent_columns
from tests.data import T0, events


@pytest.fixture(scope="module")
def a(spark):
    return events(spark).filter("tenant_id = 'a'").cache()


CASES = [
    (lambda: ~P.equals("host", "web01"), {3, 5, 6, 7, 9}),
    (lambda: P.differs("host", "web01"), {3, 4, 5, 6, 7, 9}),
    (lambda: P.above("bytes", 10), {1, 2, 3, 8}),
    (lambda: P.at_most("bytes", 5), {6, 7, 10}),
    (lambda: P.equals("nested.list.1.k", "v1"), {6}),
    (lambda: P.equals("nested.list.-1.k", "v1"), {6}),
    (lambda: P.missing("none") & P.equals("host", "MBP"), {6}),
    (lambda: P.contains("_raw", "failed"), {1, 5}),
    (lambda: ~P.contains("host", "web"), {4, 5, 6, 7}),
    (lambda: P.contains("_raw", "100%_"), {7}),
    (lambda: P.contains("_raw", "\\ back\\s"), {7}),
    (lambda: P.matches("_raw", "ZÜRICH"), {8}),
    (lambda: P.matches("_raw", "^failed.*9$"), {1}),
    (lambda: P.equals("ok", "true"), {5}),
    (lambda: P.equals("tags.0", "a"), {5}),
    (lambda: P.one_of("app_name", ["cron", "sudo"]), {3, 8, 9}),
    (lambda: ~P.one_of("app_name", ["cron", "sshd"]), {3, 4, 5, 6, 7}),
    (lambda: P.one_of("app_name", []), set()),
    (lambda: P.dataset("s*log", "router"), {1, 2, 3, 4, 7, 8, 9, 10}),
    (lambda: P.dataset("*"), set(range(1, 11))),
    (lambda: P.dataset("m_c"), set()),
    (lambda: P.equals("xdm.event.outcome", "FAILED") | P.equals("collector_id", "c4"), {1, 7}),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_conditions(a, i):
    condition, want = CASES[i]
    assert {int(r.id) for r in a.filter(condition()).collect()} == want


def test_paths_that_need_an_at(spark):
    b = events(spark).filter("tenant_id = 'b'")
    assert tuple(b.select(field("@user-agent"), field("@2fa"), field("@dataset"), field("@_time"), field("dataset")).first()) == ("x", "y", "d", "t", "syslog")


def test_numeric_segments(spark):
    df = spark.createDataFrame([('{"a":{"1":"key"}}',), ('{"a":["x","item"]}',), ('{"a":[1,{"b":null}]}',)], "j string")
    assert [r[0] for r in df.select(path_text(F.col("j"), "a.1")).collect()] == ["key", "item", '{"b":null}']
    with pytest.raises(ValueError):
        path_text(F.col("j"), "1.2.3.4")


def test_aggregates(a):
    r = Search(a).comp(n="count", hosts=("count", "host"), kinds=("count_distinct", "host"), total=("sum", "bytes"), least=("min", "bytes"), most=("max", "bytes"), mean=("avg", "bytes")).frame().first()
    assert (r.n, r.hosts, r.kinds, r.total, r.least, r.most) == (10, 9, 6, 3621.5, -3.0, 2500.0)
    assert r["mean"] == pytest.approx(3621.5 / 8)
    assert Search(a).where(P.equals("host", "nobody")).comp(n="count").frame().first().n == 0


def test_order_limit_and_pages(a):
    rows, more = Search(a).fields("_id").limit(3).page()
    assert [r._id for r in rows] == ["10", "09", "08"] and more
    rows, more = Search(a).sort("bytes").fields("bytes").page()
    assert [r["bytes"] for r in rows] == ["abc", "7", "5", "2500", "12.5", "1000", "100", "0", "-3", None] and not more
    groups = Search(a).comp("host", n="count", total=("sum", "bytes")).frame().collect()
    assert [r.host for r in groups][:2] == [None, "mbp"] and groups[-1].host == "MBP"
    r = Search(a).between("2026-10-01 00:07:00", "2026-10-01 00:27:00").fields("_id", t="_time").frame().collect()
    assert [(x._id, x.t) for x in r] == [("03", "2026-10-01 00:27:00"), ("02", "2026-10-01 00:17:00"), ("01", "2026-10-01 00:07:00")]
    assert {x["name"]: x.n for x in frequent_columns(a).collect()}["host"] == 9


def test_match_groups(a):
    one = match_groups(a).collect()
    assert [(r.group_key, r.n, r.sample_ids, r.sample_raw) for r in one] == [("all", 10, ["10", "09", "08", "07", "06"], "dup host")]
    assert (one[0].first_at, one[0].last_at) == (T0 + timedelta(minutes=7), T0 + timedelta(minutes=97))
    assert match_groups(a, after="2026-10-01 00:07:00").first().n == 9
    assert [(r.group_key, r.n) for r in match_groups(a, group=by_field("host")).collect()] == [("web01", 4), ("MBP", 1), ("mbp", 1), ("rtr", 1), ("unknown", 1), ("web02", 1), ("web03", 1)]
    assert {r.group_key: r.n for r in match_groups(a, group=by_capture(r"from (\S+)")).collect()} == {"unknown": 9, "203.0.113.9": 1}
    assert [r.n for r in match_groups(a, group=by_field("app_name"), threshold=2).collect()] == [3, 2, 2]


def test_unlimited(spark, monkeypatch):
    """All groups and rows beyond MOST_ROWS, also in the query over groupings."""
    from evspark.plans import search as plans

    many = spark.range(6000).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("tenant_id"), F.lit("s").alias("source_type"), F.concat(F.lit("c"), "id").alias("collector_id"), F.lit("2026-10-01").cast("timestamp").alias("received_at"), F.lit(None).cast("timestamp").alias("event_time"), F.lit("r").alias("raw"), F.lit('{"k":1}').alias("parsed"))
    monkeypatch.setattr(plans, "stand_in", lambda *_: many)
    assert plans.comp_multi(spark, "").count() == 6000
    assert Search(many).unlimited().frame().count() == 6000 and Search(many).frame().count() == 1000
    with pytest.raises(ValueError):
        Search(many).unlimited().page()
