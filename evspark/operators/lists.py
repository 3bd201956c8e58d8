"""Joins of block, allow and watch lists: address blocks that overlap, domains that cover, feeds that are reconciled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage
from ..functions.network import ip_range, prefix_hex
from ..functions.security import parent_domains
from ..functions.sizes import if_small

#: Pairs of a key up to which its rows are joined one by one; rows of a piece of larger groups.
FEW_PAIRS, PIECE = 4096, 256
#: Pairs that are made in one task; with more than MOST_TASKS tasks, up to LARGE_TASK.
TASK_PAIRS, MOST_TASKS, LARGE_TASK = 1 << 22, 1000, 1 << 27


def _blocks(rows: DataFrame, value: str) -> DataFrame:
    """rows of an address or block, with _start (16 bytes) and _bits."""
    # A generator makes the block once; a filter on it would make it again.
    found = rows.select("*", F.inline(F.array_compact(F.array(ip_range(F.col(value))))).alias("_start", "_r_end", "_bits", "_r_text"))
    return found.drop("_r_end", "_r_text")


def _levels(blocks: DataFrame) -> list[int]:
    """Prefix lengths that occur: at most 129 numbers."""
    return sorted(r[0] for r in blocks.select("_bits").distinct().collect())


def _above(blocks: DataFrame, levels: list[int], strictly: bool) -> DataFrame:
    """blocks, a row for each of these prefix lengths that isn't longer than its own (or is shorter), with the prefix at that length."""
    own = F.col("_bits") - int(strictly)
    at = F.filter(F.array(*[F.lit(n) for n in levels]).cast("array<int>"), lambda n: n <= own)
    each = blocks.withColumn("_n", F.explode(at))
    return each.withColumn("_at", F.when(F.col("_n") == F.col("_bits"), F.col("_start")).otherwise(F.unhex(prefix_hex(F.lower(F.hex("_start")), F.col("_n")))))


def _tasks(pairs: float) -> int:
    return max(1, min(int(pairs / TASK_PAIRS), MOST_TASKS), int(pairs / LARGE_TASK))


def _equal(left: DataFrame, right: DataFrame, of_left: DataFrame, of_right: DataFrame, key: list[str]) -> DataFrame:
    """_l and _r: pairs of the structs _row of both sides' rows (_value, _id, _row) whose values share a key, however many rows have it.

    of_left and of_right tell each value's keys, and how many _rows have it. Groups are counted first. Where two of them make more
    than FEW_PAIRS pairs, each is divided into arrays of about PIECE rows by a hash of _id; an array goes to as many tasks as the
    other group has arrays, and each pair of arrays is expanded in a task of its own place. So what is shuffled is the pairs
    divided by half a piece, no task holds a group, and rows whose keys the other side hasn't aren't shuffled.
    """
    count = lambda values, n: values.groupBy(*key).agg(F.sum("_rows").alias(n))
    n_pairs = F.col("_nl") * F.col("_nr")
    matched = cut_lineage(count(of_left, "_nl").join(count(of_right, "_nr"), key))
    total = matched.agg(F.sum(n_pairs.cast("double")).alias("n"), F.sum(F.when(n_pairs <= FEW_PAIRS, n_pairs.cast("double"))).alias("few")).first()
    all_pairs, few_pairs = total.n or 0.0, total.few or 0.0
    matched = if_small(matched)
    meets = lambda of: if_small(cut_lineage(of.join(matched, key).select("_value", *key, "_nl", "_nr")))
    met_left, met_right = meets(of_left), meets(of_right)
    rows = lambda side, met, name: side.join(met, "_value").select(*key, F.col("_row").alias(name))
    if all_pairs <= TASK_PAIRS:
        return rows(left, met_left, "_l").join(rows(right, met_right, "_r"), key).select("_l", "_r")
    parts = lambda n: F.ceil(F.col(n) / PIECE).cast("int")

    def pieces(side: DataFrame, met: DataFrame, own: str, other: str, place: str, other_place: str, name: str) -> DataFrame:
        large = met.filter(n_pairs > FEW_PAIRS).select("_value", *key, parts(own).alias("_own"), parts(other).alias("_other"))
        found = side.join(large, "_value").withColumn(place, F.pmod(F.xxhash64("_id"), F.col("_own")).cast("int"))
        found = found.groupBy(*key, place, "_other").agg(F.collect_list("_row").alias(name))
        each = found.select(*key, place, name, F.explode(F.sequence(F.lit(0), F.col("_other") - 1)).alias(other_place))
        return each.repartition(_tasks(all_pairs - few_pairs), *key, "_i", "_j")

    met = pieces(left, met_left, "_nl", "_nr", "_i", "_j", "_ls").join(pieces(right, met_right, "_nr", "_nl", "_j", "_i", "_rs"), [*key, "_i", "_j"])
    many = met.select(F.explode("_ls").alias("_l"), "_rs").select("_l", F.explode("_rs").alias("_r"))
    few = lambda side, met, name: rows(side, met.filter(n_pairs <= FEW_PAIRS), name).repartition(_tasks(few_pairs), *key)
    return many.unionByName(few(left, met_left, "_l").join(few(right, met_right, "_r"), key).select("_l", "_r"))


def overlapping(left: DataFrame, right: DataFrame, left_value: str, right_value: str) -> DataFrame:
    """Pairs of rows whose IPv4 or IPv6 addresses or blocks overlap; rows of other texts have none.

    Two blocks overlap if one contains the other, so each side's blocks are joined, by equality, with those of their prefixes
    that have a length of a block of the other side: a list of addresses and blocks has few of these, and an address is a
    row for each of them. Prefixes are 16 bytes. Texts become blocks and prefixes once each, however many rows have them. The result
    may grow with the product of both sides, what is held doesn't.
    """

    def rows(side: DataFrame, value: str) -> DataFrame:
        found = side.select(F.struct(*[F.col(f"`{c}`") for c in side.columns]).alias("_row"), F.col(value).alias("_value"))
        return cut_lineage(found.withColumn("_id", F.monotonically_increasing_id()))  # read several times

    blocks = lambda side: cut_lineage(_blocks(side.groupBy("_value").agg(F.count(F.lit(1)).alias("_rows")), "_value"))
    l_rows, r_rows = rows(left, left_value), rows(right, right_value)
    a, b = blocks(l_rows), blocks(r_rows)
    # Of each side its own blocks, which the other's prefixes meet, and its prefixes; `_in` tells which of both is the longer one.
    keyed = lambda values, inside: values.select(F.lit(inside).alias("_in"), "_n", "_at", "_value", "_rows")
    own = lambda values: values.withColumns({"_n": F.col("_bits"), "_at": F.col("_start")})
    of_a = keyed(_above(a, _levels(b), False), True).unionByName(keyed(own(a), False))
    of_b = keyed(own(b), True).unionByName(keyed(_above(b, _levels(a), True), False))
    return _equal(l_rows, r_rows, of_a, of_b, ["_in", "_n", "_at"]).select("_l.*", "_r.*")


def covered_domains(values: DataFrame, allowed: DataFrame, value: str, domain: str) -> DataFrame:
    """Pairs where a value is an allowed domain, below one, or above one."""
    below = values.withColumn("at", F.explode(parent_domains(F.col(value)))).join(allowed.withColumn("at", F.col(domain)), "at")
    above = values.withColumn("at", F.col(value)).join(allowed.withColumn("at", F.explode(parent_domains(F.col(domain)))).filter(F.col("at") != F.col(domain)), "at")
    return below.unionByName(above).drop("at")


def reconciled(listed: DataFrame, current: DataFrame, now: str) -> DataFrame:
    """A feed's indicators (type, value, source, severity, enabled, expires_at) after an import of current (type, value, source, severity).

    Rows of an imported source that it no longer lists expire now, listed ones are refreshed and enabled, rows of
    other sources stay as they are, and new ones are added (of several sources, under the smallest source and severity).
    """
    key = ["type", "value"]
    new = current.groupBy(*key).agg(F.min(F.struct("source", "severity")).alias("s")).select(*key, "s.*")
    sources = current.select(F.col("source").alias("import_source")).distinct()
    still = current.select(*key, F.col("source").alias("still_source"), F.lit(True).alias("still")).distinct()
    old = listed.join(still, (listed["type"] == still["type"]) & (listed["value"] == still["value"]) & (F.col("source") == F.col("still_source")), "left")
    old = old.select(listed["*"], "still").join(sources, F.col("source") == F.col("import_source"), "left")
    same = F.col("import_source").isNotNull()
    gone = same & F.col("still").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp")))
    old = old.withColumn("enabled", F.when(same & F.col("still"), F.lit(True)).otherwise(F.col("enabled")))
    old = old.withColumn("expires_at", F.when(gone, F.lit(now).cast("timestamp")).when(same & F.col("still"), F.lit(None)).otherwise(F.col("expires_at")))
    added = new.join(listed.select(*key), key, "left_anti").withColumns({"enabled": F.lit(True), "expires_at": F.lit(None).cast("timestamp")})
    return old.select(*listed.columns).unionByName(added.select(*[c for c in listed.columns if c in added.columns]), allowMissingColumns=True)


def shrank(now: Column, before: Column) -> Column:
    """A feed that lost more than four fifths of at least twenty values is not trusted."""
    return (now < 0.2 * before) & (before >= 20)


#: Bytes of a published list up to which its tag is the SHA-256 of its text, as clients can compute it.
PLAIN_BYTES = 8 << 20


def etag(entries: DataFrame, now: str, plain_bytes: int = PLAIN_BYTES) -> DataFrame:
    """One row: the tag of the published list, which changes with any of its lines.

    Up to plain_bytes, which is counted first, it is the SHA-256 of the lines in order, joined by newlines. A longer list has
    one made in tasks: the exclusive or of the lines' SHA-256 digests, in four numbers, with the number of lines; lines are
    distinct, so that none cancels another, and no row holds the list.
    """
    lines = published(entries, now)
    n_bytes = lines.agg(F.sum(F.octet_length("value") + F.lit(1))).first()[0] or 0
    if n_bytes <= plain_bytes:
        joined = F.array_join(F.sort_array(F.collect_list("value")), "\n")
        return lines.agg(F.sha2(joined.cast("binary"), 256).alias("etag"))
    digest = F.sha2(F.col("value").cast("binary"), 256)
    quarter = lambda i: F.bit_xor(F.conv(F.substr(digest, F.lit(16 * i + 1), F.lit(16)), 16, -10).cast("long")).alias(f"q{i}")
    parts = lines.agg(*[quarter(i) for i in range(4)], F.count(F.lit(1)).alias("n"))
    folded = F.concat_ws(":", *[F.lower(F.hex(f"q{i}")) for i in range(4)], F.col("n").cast("string"))
    return parts.select(F.sha2(folded.cast("binary"), 256).alias("etag"))


def with_counts(lists: DataFrame, entries: DataFrame, now: str) -> DataFrame:
    """Lists (list_id, name) with their active entries (list_id, value, expires_at), by name whatever its case."""
    active = entries.filter(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp")))
    n = active.groupBy("list_id").agg(F.count(F.lit(1)).alias("entry_count"))
    return lists.join(n, "list_id", "left").withColumn("entry_count", F.coalesce("entry_count", F.lit(0))).orderBy(F.lower("name"), "list_id")


#: Rows of a page of entries at most.
MOST_ENTRIES = 500


def entries_page(entries: DataFrame, list_id: str | int, now: str, text: str = "", expired: bool = False, limit: int = 100, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of a list's active entries, or of its expired ones, that have a text in them whatever its case, latest first; and one row with the total."""
    gone = F.coalesce(F.col("expires_at") <= F.lit(now).cast("timestamp"), F.lit(False))
    found = entries.filter((F.col("list_id") == F.lit(list_id)) & (gone if expired else ~gone))
    if text:
        found = found.filter(F.contains(F.lower("value"), F.lower(F.lit(text))))
    return found.orderBy(F.desc("added_at"), "value").offset(offset).limit(min(limit, MOST_ENTRIES)), found.agg(F.count(F.lit(1)).alias("total"))


def published(entries: DataFrame, now: str) -> DataFrame:
    """Active values in order, one a row."""
    active = F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp"))
    return entries.filter(active).select("value").distinct().orderBy("value")
