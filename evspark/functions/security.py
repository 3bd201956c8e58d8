"""Security text: indicators and their candidates in raw text, address ranges, list values, severities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities from worst to least, and level bands.
SEVERITIES = ("critical", "high", "medium", "low")
BANDS = ((12, "critical"), (8, "high"), (5, "medium"))
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
# In events an octet below 100 may have a zero before it.
_LOOSE = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
LOOSE_IPV4 = rf"{_LOOSE}(?:\.{_LOOSE}){{3}}"
MAIL = r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
DOMAIN = r"(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}"


def refang(c: Column) -> Column:
    """hxxp, [.], (.), {.}, [:], [@] and (at) as they were."""
    # The spellings by which indicators are made harmless.
    c = F.regexp_replace(c, r"(?i)^hxxp", "http")
    c = F.regexp_replace(c, r"\[\.\]|\(\.\)|\{\.\}", ".")
    c = F.regexp_replace(c, r"\[:\]", ":")
    return F.regexp_replace(c, r"(?i)\[@\]|\(at\)", "@")


#: Code points of an indicator at most.
MOST_INDICATOR = 2048


def classify(c: Column) -> Column:
    """url, md5, sha1, sha256, ip, email or domain, in this order, or null."""
    v = F.lower(refang(F.trim(c)))
    v = F.when(F.char_length(v) <= MOST_INDICATOR, v)
    return (
        F.when(v.rlike(r"^https?://\S+\z"), "url")
        .when(v.rlike(r"^[0-9a-f]{32}\z"), "md5")
        .when(v.rlike(r"^[0-9a-f]{40}\z"), "sha1")
        .when(v.rlike(r"^[0-9a-f]{64}\z"), "sha256")
        .when(v.rlike(rf"^{LOOSE_IPV4}\z"), "ip")
        .when(v.rlike(rf"^{MAIL}\z"), "email")
        .when(v.rlike(rf"^{DOMAIN}\z"), "domain")
    )


def _typed(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(kind + ":"), v))


def parent_domains(domain: Column) -> Column:
    """The domain and those above it, of two labels or more."""
    labels = F.split(domain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def url_prefixes(url: Column) -> Column:
    """A URL, itself without its query, every path above it, and its origin with and without a slash."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    origin = F.regexp_extract(url, r"^(https?://[^/?#\s]+)", 1)
    path = F.filter(F.split(F.substr(bare, F.char_length(origin) + 1), "/"), lambda p: p != "")
    paths = F.transform(F.sequence(F.lit(0), F.size(path)), lambda i: F.concat(origin, F.when(i > 0, F.concat(F.lit("/"), F.array_join(F.slice(path, F.lit(1), i), "/"))).otherwise("")))
    return F.array_distinct(F.concat(F.array(url, bare, F.concat(origin, F.lit("/"))), paths))


#: Every text with a candidate has one of these; prose has few, so that it costs one pass.
_HINT = r"[a-z0-9]\.[a-z]{2}|[0-9]\.[0-9]|[0-9a-f]{32}|://|@"


def candidates(raw: Column) -> Column:
    """Distinct `type:value` strings that an indicator could be equal to: addresses, hashes, URLs and their prefixes, mail addresses, domains and their parents.

    URLs lose closing punctuation at their end. Each kind stands between characters that aren't ASCII letters, digits or
    underscores. Null has no candidates.
    """
    low = F.lower(raw)
    found = lambda p: F.regexp_extract_all(low, F.lit(p), F.lit(0))
    urls = F.transform(found(r"(?<!\w)https?://[^\s\"'<>]+"), lambda u: F.regexp_replace(u, r"[.,;)\]]+\z", ""))
    urls = F.filter(urls, lambda u: u.rlike("^https?://[^/?#]"))
    hashes = found(r"(?<!\w)(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?!\w)")
    kind = lambda h: F.when(F.char_length(h) == 32, "md5:").when(F.char_length(h) == 40, "sha1:").otherwise("sha256:")
    every = F.array_distinct(
        F.concat(
            _typed("ip", found(rf"(?<!\w){LOOSE_IPV4}(?!\w)")),
            F.transform(hashes, lambda h: F.concat(kind(h), h)),
            _typed("url", F.flatten(F.transform(urls, url_prefixes))),
            _typed("email", found(rf"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w)){MAIL}")),
            _typed("domain", F.flatten(F.transform(found(rf"(?<!\w){DOMAIN}(?!\w)"), parent_domains))),
        )
    )
    return F.when(low.rlike(_HINT), every).otherwise(F.array().cast("array<string>"))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value evaluated once for a row, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ipv4_range(c: Column) -> Column:
    """start and end of an address without leading zeros or a CIDR block, host bits cleared; null for any other text."""

    def block(p: Column) -> Column:
        octet = lambda i: F.get(p, F.lit(i))
        n = octet(0) * (1 << 24) + octet(1) * (1 << 16) + octet(2) * (1 << 8) + octet(3)
        size = F.call_function("shiftleft", F.lit(1).cast("long"), (32 - F.coalesce(octet(4), F.lit(32))).cast("int"))
        ends = let(F.struct(n.alias("n"), size.alias("size")), lambda b: let(b["n"] - F.pmod(b["n"], b["size"]), lambda start: F.struct(start.alias("start"), (start + b["size"] - 1).alias("end"))))
        return F.when(F.coalesce(octet(4), F.lit(32)) <= 32, ends)

    return F.when(c.rlike(rf"^{IPV4}(?:/[0-9]{{1,2}})?\z"), let(F.split(c, "[./]").try_cast("array<bigint>"), block))


def ipv4_text(n: Column) -> Column:
    return F.concat_ws(".", *[F.pmod(F.call_function("shiftright", n, F.lit(s)), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])


def severity_rank(c: Column) -> Column:
    """0 for the worst; unknown ones come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), c), F.lit(0)) - 1, F.lit(len(SEVERITIES)))


def severity_of_rank(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), rank.cast("int"))


def severity_of_level(level: Column) -> Column:
    chain = F.when(level >= BANDS[0][0], BANDS[0][1])
    for least, name in BANDS[1:]:
        chain = chain.when(level >= least, name)
    return chain.otherwise("low")


def daily_id(*parts: Column) -> Column:
    """The same id for the same parts: a UUID of version 5 and the usual variant, of the SHA-256 of the parts between colons."""
    h = F.sha2(F.concat_ws(":", *parts), 256)
    return F.concat(F.left(h, F.lit(8)), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
