"""The indicator library: imports, listings, summaries; and the checks of list values."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.network import ip_range
from ..functions.security import DOMAIN, classify, ipv4_range, refang

# Private and reserved IPv4 blocks.
PRIVATE = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "100.64.0.0/10", "0.0.0.0/8", "224.0.0.0/4", "240.0.0.0/4")
WIDEST_BITS = 8


def imported(library: DataFrame, lines: DataFrame, source: str, severity: str, column: str = "value") -> DataFrame:
    """The library (type, value, source, severity, enabled) after an import of lines: what is known takes the new source and severity and is enabled again.

    Other columns of the library keep their values for what is known, but expires_at, which an import clears.
    """
    typed = lines.select(classify(F.col(column)).alias("type"), F.lower(refang(F.trim(F.col(column)))).alias("value")).filter(F.col("type").isNotNull()).dropDuplicates()
    new = typed.select("type", "value", F.lit(True).alias("_new"))
    both = library.withColumn("_old", F.lit(True)).join(new, ["type", "value"], "full_outer")
    changed = {"source": F.lit(source), "severity": F.lit(severity), "enabled": F.lit(True)} | ({"expires_at": F.lit(None).cast(library.schema["expires_at"].dataType)} if "expires_at" in library.columns else {})
    return both.withColumns({c: F.when(F.col("_new"), v).otherwise(F.col(c)) for c, v in changed.items()}).select(*library.columns)


def listing(library: DataFrame, kind: str | None = None, source: str | None = None, text: str | None = None, offset: int = 0, limit: int = 200) -> DataFrame:
    for value, condition in ((kind, lambda v: F.col("type") == v), (source, lambda v: F.col("source") == v), (text, lambda v: F.contains("value", F.lower(F.lit(v))))):
        if value is not None:
            library = library.filter(condition(value))
    newest = [F.col("created_at").desc(), F.col("id").asc()] if {"created_at", "id"} <= set(library.columns) else []
    return library.orderBy(*newest, "type", "value").offset(offset).limit(min(limit, 200))


def by_type(library: DataFrame, now: str) -> DataFrame:
    """Per type: indicators, and active ones: enabled and not expired."""
    live = F.col("enabled") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp")))
    return library.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(live).alias("n_active"))


def by_source(library: DataFrame) -> DataFrame:
    """Per source: indicators, enabled ones, their types, and the last update where the library has one."""
    last = [F.max("updated_at").alias("last_update")] if "updated_at" in library.columns else []
    return library.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("enabled").alias("n_enabled"), F.sort_array(F.collect_set("type")).alias("types"), *last)


def feeds_due(feeds: DataFrame, now: str) -> DataFrame:
    """Feeds (name, last_run, every_minutes) whose next run has come; never run ones first."""
    due = F.col("last_run").isNull() | (F.col("last_run") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("every_minutes")) <= F.lit(now).cast("timestamp"))
    return feeds.filter(due).orderBy(F.asc_nulls_first("last_run"), "name")


def normal_value(kind: Column, value: Column) -> Column:
    """The normal form of a list value of kind ip, domain, url or hash; null if it isn't one."""
    v = F.trim(refang(value))
    low = F.lower(v)
    domain = F.regexp_replace(F.regexp_replace(low, r"^\*\.", ""), r"\.$", "")
    url = F.concat(F.lower(F.regexp_extract(v, r"^(https?://[^/?#]+)", 1)), F.regexp_replace(F.regexp_extract(v, r"^https?://[^/?#]+([^#]*)", 1), r"^/$", ""))
    return (
        F.when((kind == "ip") & ipv4_range(v).isNotNull(), v)
        .when((kind == "ip") & v.contains(":"), ip_range(v)["text"])
        .when((kind == "domain") & domain.rlike(rf"^{DOMAIN}\z"), domain)
        .when((kind == "url") & v.rlike(r"^https?://[^\s/?#]+"), url)
        .when((kind == "hash") & low.rlike(r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})\z"), low)
    )


def refusal(value: Column, allow_private: bool = False) -> Column:
    """Why an address or block can't be listed: too wide, or private; null if it can."""
    r = ipv4_range(value)
    wide = r["end"] - r["start"] >= 2 ** (32 - WIDEST_BITS)
    own = [ipv4_range(F.lit(p)) for p in PRIVATE]
    private = F.lit(False)
    for p in own:
        private = private | ((r["start"] <= p["end"]) & (p["start"] <= r["end"]))
    return F.when(wide, "too wide").when(F.lit(not allow_private) & private, "private")


# Widest blocks of a block list by family, addresses that are on no list, and private ones.
WIDEST_PREFIX = {4: 8, 6: 32}
NEVER = ("0.0.0.0/8", "127.0.0.0/8", "224.0.0.0/4", "240.0.0.0/4", "::/128", "::1/128", "ff00::/8")
PRIVATE_ANY = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "100.64.0.0/10", "fc00::/7", "fe80::/10")


def _bounds(block: str) -> tuple[bytes, bytes]:
    net = ipaddress.ip_network(block)
    base = 0xFFFF << 32 if net.version == 4 else 0
    first, last = int(net.network_address), int(net.broadcast_address)
    return (base + first).to_bytes(16, "big"), (base + last).to_bytes(16, "big")


def refusal_any(values: DataFrame, value: str, allow_private: bool = False) -> DataFrame:
    """values with `refused`: why an IPv4 or IPv6 address or block can't be on a block list: not one, too wide, reserved, or private; null if it can."""
    found = values.withColumn("_r", ip_range(F.col(value)))
    start, end, text = F.col("_r.start"), F.col("_r.end"), F.col("_r.text")
    prefix = F.regexp_extract(text, r"/([0-9]+)$", 1).try_cast("int")
    wide = prefix < F.when(text.contains(":"), WIDEST_PREFIX[6]).otherwise(WIDEST_PREFIX[4])

    def meets(blocks: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for lo, hi in map(_bounds, blocks):
            hit = hit | ((start <= F.lit(hi)) & (F.lit(lo) <= end))
        return hit

    reason = F.when(text.isNull(), "no address").when(wide, "too wide").when(meets(NEVER), "reserved").when(F.lit(not allow_private) & meets(PRIVATE_ANY), "private")
    return found.withColumn("refused", reason).drop("_r")
