"""Queries over the stand-in events: searches and grouped detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators.match import by_capture, by_field, match_groups
from ..operators.search import Search, frequent_columns
from ..sources.envelope import STAND_IN_SQL, stand_in

SECOND = "yyyy-MM-dd HH:mm:ss"
SQL_SECOND = "'%Y-%m-%d %H:%M:%S'"


def _search(spark: SparkSession, sf_dir: str) -> Search:
    return Search(stand_in(spark, sf_dir))


def _ids(*conditions):
    """Ids of the events that the conditions keep."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = stand_in(spark, sf_dir)
        for c in conditions:
            found = found.filter(c())
        return found.select("id")

    return run


def _where(condition: str) -> str:
    return f"with {STAND_IN_SQL} select id from e where {condition}"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _search(spark, sf_dir).where(P.dataset("error", "view"), P.above("k", 50))
    return found.comp("source_type", hits="count", avg_k=("avg", "k")).sort("source_type").frame().withColumn("avg_k", F.round("avg_k", 6))


def fields_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir).where(P.dataset("error")).fields("source_type", number="k", who="_raw", key="_id").unlimited().frame()


def time_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir).fields("_id", "_time", "_insert_time").unlimited().frame()


def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir).between("2024-01-05 00:00:00", "2024-01-06 12:00:00").fields("_id").unlimited().frame()


def raw_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir).where(P.dataset("signup")).unlimited().frame().withColumn("_time", F.date_format("_time", SECOND))


def count_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir).comp("source_type", n="count").frame()


def comp_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir).comp("source_type", "collector_id", n="count", with_k=("count", "k"), kinds=("count_distinct", "k")).unlimited().frame()


def comp_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _search(spark, sf_dir).comp("collector_id", total=("sum", "k"), least=("min", "k"), most=("max", "k"), mean=("avg", "k")).frame()
    return found.withColumn("mean", F.round("mean", 6))


def comp_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir).where(P.equals("source_type", "no such")).comp(n="count", with_k=("count", "k"), total=("sum", "k")).frame()


def comp_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir).comp(collectors=("count_distinct", "collector_id"), raws=("count_distinct", "_raw")).frame()


def sort_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir).where(P.present("k")).sort("k", "_id", ascending=True).fields("_id", "k").limit(100).frame()


def sort_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir).sort(("source_type", "asc"), ("k", "desc"), ("_id", "asc")).fields("_id", "k").limit(1000).frame()


def default_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir).comp("k", n="count", total=("sum", "k")).limit(20).frame()


def top_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent_columns(stand_in(spark, sf_dir))


def _groups(found: DataFrame) -> DataFrame:
    return found.select("group_key", "n", F.date_format("first_at", SECOND).alias("first_at"), F.date_format("last_at", SECOND).alias("last_at"), F.array_join("sample_ids", ",").alias("sample_ids"), "sample_raw")


def match_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(match_groups(stand_in(spark, sf_dir), P.dataset("error"), after="2024-01-10 00:00:00"))


def match_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(match_groups(stand_in(spark, sf_dir), group=by_field("collector_id")))


def match_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(match_groups(stand_in(spark, sf_dir), group=by_capture(r"user=(\d)\d"), limit=20))


def match_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(match_groups(stand_in(spark, sf_dir), P.above("k", 20), group=by_field("k"), threshold=20, limit=50))


def _match_sql(where: str, key: str, threshold: int, limit: int) -> str:
    return f"""with {STAND_IN_SQL}, m as (select {key} as group_key, evt, id, raw from e where {where}),
r as (select *, row_number() over (partition by group_key order by evt desc, id desc) as rn from m),
g as (select group_key, count(*) as n, strftime(min(evt), {SQL_SECOND}) as first_at, strftime(max(evt), {SQL_SECOND}) as last_at,
  string_agg(id, ',' order by rn) filter (rn <= 5) as sample_ids, max(raw) filter (rn = 1) as sample_raw from r group by group_key)
select * from g where n >= {threshold} order by n desc, group_key limit {limit}"""


QUERIES = {
    "xql_flagship": flagship,
    "xql_dataset_eq": _ids(lambda: P.dataset("click")),
    "xql_dataset_in": _ids(lambda: P.dataset("click", "error")),
    "xql_dataset_glob": _ids(lambda: P.dataset("*i*n*", "view")),
    "xql_filter_eq": _ids(lambda: P.equals("k", "7")),
    "xql_filter_ne": _ids(lambda: P.differs("k", "7")),
    "xql_filter_missing": _ids(lambda: P.missing("k"), lambda: P.present("collector_id")),
    "xql_filter_contains": _ids(lambda: P.contains("_raw", "SER=1")),
    "xql_filter_in": _ids(lambda: ~P.one_of("k", ["1", "2", "x"])),
    "xql_filter_regex": _ids(lambda: P.matches("_raw", "^(ERROR|view) .*=[0-4]$")),
    "xql_filter_number": _ids(lambda: P.above("k", 9) & P.at_most("k", 30)),
    "xql_filter_not": _ids(lambda: ~P.equals("k", "7"), lambda: P.equals("source_type", "click") | ~P.equals("collector_id", "c3")),
    "xql_fields_alias": fields_alias,
    "xql_time_text": time_text,
    "xql_time_range": time_range,
    "xql_raw_mode": raw_mode,
    "xql_comp_count_by": count_by,
    "xql_comp_multi": comp_multi,
    "xql_comp_numeric": comp_numeric,
    "xql_comp_global": comp_global,
    "xql_comp_distinct": comp_distinct,
    "xql_sort_limit": sort_limit,
    "xql_sort_mixed": sort_mixed,
    "xql_default_sort_comp": default_sort,
    "xql_top_columns": top_columns,
    "match_none": match_none,
    "match_field": match_field,
    "match_capture": match_capture,
    "match_threshold": match_threshold,
}

ORACLE_SQL = {
    "xql_flagship": f"with {STAND_IN_SQL} select source_type, count(*) as hits, round(avg(cast(k as double)), 6) as avg_k from e where source_type in ('error', 'view') and cast(k as double) > 50 group by 1",
    "xql_dataset_eq": _where("source_type = 'click'"),
    "xql_dataset_in": _where("source_type in ('click', 'error')"),
    "xql_dataset_glob": _where("source_type like '%i%n%' or source_type = 'view'"),
    "xql_filter_eq": _where("k = '7'"),
    "xql_filter_ne": _where("k is distinct from '7'"),
    "xql_filter_missing": _where("k is null and collector_id is not null"),
    "xql_filter_contains": _where("contains(lower(raw), 'ser=1')"),
    "xql_filter_in": _where("coalesce(k not in ('1', '2', 'x'), true)"),
    "xql_filter_regex": _where("regexp_matches(raw, '(?is)^(ERROR|view) .*=[0-4]$')"),
    "xql_filter_number": _where("cast(k as double) > 9 and cast(k as double) <= 30"),
    "xql_filter_not": _where("not k = '7' and (source_type = 'click' or not collector_id = 'c3')"),
    "xql_fields_alias": f'with {STAND_IN_SQL} select source_type, k as "number", raw as who, id as "key" from e where source_type = \'error\'',
    "xql_time_text": f"with {STAND_IN_SQL} select id as _id, cast(evt as varchar) as _time, cast(received_at as varchar) as _insert_time from e",
    "xql_time_range": f"with {STAND_IN_SQL} select id as _id from e where evt between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-06 12:00:00'",
    "xql_raw_mode": f"with {STAND_IN_SQL} select id as _id, strftime(evt, {SQL_SECOND}) as _time, source_type, collector_id, raw as _raw, parsed from e where source_type = 'signup'",
    "xql_comp_count_by": f"with {STAND_IN_SQL} select source_type, count(*) as n from e group by 1",
    "xql_comp_multi": f"with {STAND_IN_SQL} select source_type, collector_id, count(*) as n, count(k) as with_k, count(distinct k) as kinds from e group by 1, 2",
    "xql_comp_numeric": f"with {STAND_IN_SQL} select collector_id, sum(cast(k as double)) as total, min(cast(k as double)) as least, max(cast(k as double)) as most, round(avg(cast(k as double)), 6) as mean from e group by 1",
    "xql_comp_global": f"with {STAND_IN_SQL} select count(*) as n, count(k) as with_k, sum(cast(k as double)) as total from e where source_type = 'no such'",
    "xql_comp_distinct": f"with {STAND_IN_SQL} select count(distinct collector_id) as collectors, count(distinct raw) as raws from e",
    "xql_sort_limit": f"with {STAND_IN_SQL} select id as _id, k from e where k is not null order by k, id limit 100",
    "xql_sort_mixed": f"with {STAND_IN_SQL} select id as _id, k from e order by source_type, k desc nulls last, id limit 1000",
    "xql_default_sort_comp": f"with {STAND_IN_SQL} select k, count(*) as n, sum(cast(k as double)) as total from e group by 1 order by total desc nulls first, k nulls first limit 20",
    "xql_top_columns": f"with {STAND_IN_SQL} select name, count(*) as n from (select unnest(json_keys(parsed)) as name from e) group by 1 order by n desc, name limit 40",
    "match_none": _match_sql("source_type = 'error' and evt > timestamp '2024-01-10 00:00:00'", "'all'", 1, 1000),
    "match_field": _match_sql("true", "coalesce(collector_id, 'unknown')", 1, 1000),
    "match_capture": _match_sql("true", "coalesce(nullif(regexp_extract(raw, 'user=(\\d)\\d', 1), ''), 'unknown')", 1, 20),
    "match_threshold": _match_sql("cast(k as double) > 20", "coalesce(k, 'unknown')", 20, 50),
}
