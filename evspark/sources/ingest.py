"""Sources: log lines, JSON batches, syslog, feeds of indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.security import classify, refang

MOST_LINE, MOST_HOST = 8192, 200
#: Indicators of a feed at most; a longer one is refused whole, since a cut list would let the wrong ones expire.
MOST_ITEMS = 50_000
# Names of syslog severities and facilities by number, as they are stored.
SYSLOG_SEVERITIES = ("emerg", "alert", "crit", "err", "warning", "notice", "info", "debug")
SYSLOG_FACILITIES = (
    "kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp", "ntp", "security", "console", "solaris-cron",
    "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7",
)
# Keys that a JSON feed's list can be under, and fields of its items that can hold the indicator, in this order.
FEED_LISTS = ("indicators", "iocs", "data", "items", "results", "values", "observables")
FEED_FIELDS = ("value", "indicator", "ioc", "observable", "ip", "ip_address", "domain", "hostname", "url", "hash", "sha256", "sha1", "md5", "email")

# How months are named in times without a year.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_CLOCK = r"^[0-9]{2}:[0-9]{2}:[0-9]{2}"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
# Structured data by the grammar of RFC 5424: elements side by side, a value's quotes, backslashes and brackets being escaped.
_NAME = r"""[!#-<>-\\^-~]++"""
_PARAM = rf"""\s{_NAME}="[^"\\\]]*+(?:\\.[^"\\\]]*+)*+" """.strip()
_DATA = rf"^(-|(?:\[{_NAME}(?:{_PARAM})*+\s?\])+)(?:\s|$)"


def line_time(c: Column) -> Column:
    """Only times that begin with a full date are trusted; without a zone they are UTC."""
    t = F.regexp_replace(F.trim(c), r"^([0-9]{4}-[0-9]{2}-[0-9]{2}) ", "$1T")
    t = F.regexp_replace(t, r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    return F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(t))


def _words(text: Column, n: int) -> Column:
    """The first n words of a text and the rest of it."""
    return F.split(text, r"\s+", n + 1)


def _yearless(words: Column, at: int) -> Column:
    """Whether the words from `at` on are a month, a day and a time."""
    w = lambda i: F.get(words, F.lit(at + i))
    return w(0).isin(*MONTHS) & w(1).rlike("^[0-9]{1,2}$") & w(2).rlike(_CLOCK + "$")


def _before_colon(text: Column) -> tuple[Column, Column]:
    """What stands before the first colon of a text (null without one, or at its beginning) and after it."""
    at = F.locate(":", text)
    return F.when(at > 1, F.substring_index(text, ":", 1)), F.ltrim(F.substr(text, at + 1))


def text_lines(lines: DataFrame, host: str | None = None, column: str = "value") -> DataFrame:
    """raw, event_time and parsed of lines of a log file: a stamp of one to three words, the host, the program with or without
    a process number, a colon, the message. Lines of another form keep only their text and the given host. Blank lines are left out.
    """
    rows = lines.filter(F.trim(F.col(column)) != "").select(F.left(F.col(column), F.lit(MOST_LINE)).alias("raw"))
    words = _words(F.col("raw"), 4)
    w = lambda i: F.get("words", F.lit(i))
    stamp_words = F.when(w(0).rlike(_DATE + f"[T]{_CLOCK[1:]}"), 1).when(w(0).rlike(_DATE + "$") & w(1).rlike(_CLOCK), 2).when(_yearless(F.col("words"), 0), 3)
    rows = rows.withColumn("words", words).withColumn("k", stamp_words)
    rest = F.get(F.split("raw", r"\s+", F.col("k") + 2), F.col("k") + 1)
    program, message = _before_colon(F.col("rest"))
    rows = rows.withColumn("rest", rest).withColumns({"program": program, "message": message})
    fits = F.coalesce(F.col("program").rlike(r"^[^\s\[\]]+(\[[0-9]+\])?$"), F.lit(False))
    number = F.nullif(F.regexp_extract("program", r"\[([0-9]+)\]$", 1), F.lit(""))
    known = F.struct(F.lit("syslog-file").alias("format"), F.get("words", F.col("k")).alias("host"), F.substring_index("program", "[", 1).alias("app_name"), number.alias("proc_id"), "message")
    other = F.struct(F.lit("plain").alias("format"), F.lit(host).cast("string").alias("host"), F.col("raw").alias("message"))
    keep = {"ignoreNullFields": "false"}
    stamp = F.array_join(F.slice("words", F.lit(1), F.col("k")), " ")
    return rows.select("raw", F.when(fits, line_time(stamp)).alias("event_time"), F.when(fits, F.to_json(known, keep)).otherwise(F.to_json(other, keep)).alias("parsed"))


def syslog(messages: DataFrame, column: str = "value", year: int | None = None) -> DataFrame:
    """raw, event_time and parsed of syslog messages: RFC 5424, then RFC 3164, then the priority alone.

    Both begin with the priority. The newer form goes on with version, time, host, application, process, message id and
    structured data (what isn't by the grammar belongs to the message), the older with month, day, time, host, a tag up to a
    colon. Times without a year are of `year`, else of the current one. Blank messages are left out.
    """
    rows = messages.select(F.trim(F.left(F.col(column), F.lit(MOST_LINE))).alias("raw")).filter(F.col("raw") != "")
    digits = F.regexp_extract("raw", "^<([0-9]{1,3})>", 1)
    rows = rows.withColumn("digits", digits).withColumn("body", F.when(F.col("digits") != "", F.substr("raw", F.char_length("digits") + 3)))
    rows = rows.withColumns({"n": _words(F.col("body"), 6), "o": _words(F.col("body"), 4)})
    n, o = (lambda i: F.get("n", F.lit(i))), (lambda i: F.get("o", F.lit(i)))
    tag, text = _before_colon(o(4))
    is_new = F.coalesce(n(0).rlike("^[1-9][0-9]{0,2}$") & (F.size("n") == 7), F.lit(False))
    rows = rows.withColumns({"new": is_new, "old": ~is_new & F.coalesce(_yearless(F.col("o"), 0) & tag.isNotNull(), F.lit(False)), "data": F.regexp_extract(n(6), _DATA, 1)})
    new, old = F.col("new"), F.col("old")
    filled = lambda c: F.nullif(F.nullif(c, F.lit("-")), F.lit(""))
    priority = F.col("digits").try_cast("int")
    names = lambda xs: F.array(*[F.lit(x) for x in xs])
    which = F.floor(priority / 8).cast("int")
    head = [
        F.when(new, "rfc5424").when(old, "rfc3164").otherwise("unstructured").alias("format"),
        F.when(priority.isNotNull(), F.coalesce(F.get(names(SYSLOG_FACILITIES), which), F.concat(F.lit("unknown("), which.cast("string"), F.lit(")")))).alias("facility"),
        F.get(names(SYSLOG_SEVERITIES), F.pmod(priority, F.lit(8))).alias("severity"),
        F.when(new, n(2)).when(old, o(3)).alias("host"),
    ]
    after_data = F.when(F.col("data") == "", n(6)).otherwise(F.substr(n(6), F.char_length("data") + 2))
    message = F.when(new, after_data).when(old, text).otherwise(F.col("raw")).alias("message")
    with_ids = F.struct(*head, filled(n(3)).alias("app_name"), filled(n(4)).alias("proc_id"), filled(n(5)).alias("msg_id"), filled(F.col("data")).alias("structured_data"), message)
    with_tag = F.struct(*head, F.trim(tag).alias("tag"), message)
    keep = {"ignoreNullFields": "false"}
    parsed = F.when(new, F.to_json(with_ids, keep)).when(old, F.to_json(with_tag, keep)).otherwise(F.to_json(F.struct(*head, message), keep))
    of_year = F.lit(str(year)) if year else F.year(F.current_timestamp()).cast("string")
    yearless = F.try_to_timestamp(F.concat_ws(" ", of_year, o(0), o(1), o(2)), F.lit("yyyy MMM d HH:mm:ss"))
    return rows.select("raw", F.when(new, F.try_to_timestamp(n(1))).when(old, yearless).alias("event_time"), parsed.alias("parsed"))


def json_batch(rows: DataFrame, host: str | None = None) -> DataFrame:
    """raw, event_time and parsed of JSON rows with raw or message, and optionally time, host and fields (JSON text).

    The document holds the fields, and over them format, host (else the given one) and message. Rows without text are left out.
    """
    have = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    raw = F.left(F.coalesce(have("raw"), have("message")), F.lit(MOST_LINE))
    own = F.struct(
        F.lit("json").alias("format"),
        F.left(F.coalesce(F.nullif(have("host"), F.lit("")), F.lit(host).cast("string")), F.lit(MOST_HOST)).alias("host"),
        F.left(F.coalesce(have("message"), raw), F.lit(MOST_LINE)).alias("message"),
    )
    as_map = lambda c: F.from_json(c, "map<string,variant>")
    own_map = as_map(F.to_json(own))
    fields = F.when(have("fields").rlike(r"^\s*\{"), as_map(have("fields")))
    kept = F.map_filter(F.coalesce(fields, as_map(F.lit("{}"))), lambda k, v: ~k.isin("format", "host", "message"))
    found = rows.select(raw.alias("raw"), line_time(have("time")).alias("event_time"), F.to_json(F.map_concat(kept, own_map)).alias("parsed"))
    return found.filter(F.trim("raw") != "")


def _bare(c: Column) -> Column:
    """A feed's line without its comment."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^\s*(?:#|;|//).*$", ""), r"\s+(?:#|;|//)\s.*$", ""))


def csv_cells(line: Column) -> Column:
    """Cells of a line between commas, semicolons and tabs outside quotes; a quote inside quotes is written twice."""
    cells = F.regexp_extract_all(line, F.lit(r'((?:"(?:[^"]|"")*+"|[^,;\t"]|")*+)(?:[,;\t]|$)'), F.lit(1))
    return F.transform(cells, lambda c: F.trim(F.replace(F.regexp_replace(F.replace(c, F.lit('""'), F.lit("\u0001")), '"', ""), F.lit("\u0001"), F.lit('"'))))


def feed_values(lines: DataFrame, source: str, severity: str, column: str = "value", form: str = "csv") -> DataFrame:
    """type, value, source and severity of a feed: of text, the first word of each line; of CSV, the first cell that is an indicator; of JSON, one document a row.

    A JSON document is a list, or has one under a key of FEED_LISTS; its items are texts, or objects with the indicator in a field of FEED_FIELDS.
    Any other document is refused when the feed is read, with an error that begins with BAD_FORMAT: read as an empty feed it would let all its
    indicators expire.
    """
    if form == "json":
        c = F.trim(F.col(column))
        lists = F.coalesce(F.when(c.startswith("["), c), *[F.when(F.get_json_object(c, f"$.{k}").startswith("["), F.get_json_object(c, f"$.{k}")) for k in FEED_LISTS])
        valid = F.try_parse_json(c).isNotNull()
        refusal = F.when(valid, F.lit("BAD_FORMAT: the JSON feed has no list of indicators")).otherwise("BAD_FORMAT: the feed is not valid JSON")
        found = F.when(valid & lists.isNotNull(), F.from_json(lists, "array<variant>")).otherwise(F.raise_error(refusal))
        items = lines.select(F.explode(found).alias("v")).select(F.to_json("v").alias("j"))
        fields = [F.get_json_object("j", f"$.{k}") for k in FEED_FIELDS]
        of_object = F.get(F.filter(F.array(*fields), lambda f: classify(f).isNotNull()), F.lit(0))
        cell = F.when(F.col("j").startswith("{"), of_object).when(F.col("j").startswith('"'), F.get_json_object(F.concat(F.lit("["), "j", F.lit("]")), "$[0]"))
        found = items.select(cell.alias("cell"))
    else:
        bare = _bare(F.col(column))
        first = F.get(F.filter(csv_cells(bare), lambda x: classify(x).isNotNull()), F.lit(0)) if form == "csv" else F.regexp_extract(bare, r"^(\S+)", 1)
        found = lines.select(first.alias("cell"))
    typed = found.select(classify(F.col("cell")).alias("type"), F.lower(refang(F.trim("cell"))).alias("value")).filter(F.col("type").isNotNull())
    return typed.dropDuplicates().withColumns({"source": F.lit(source), "severity": F.lit(severity)})


def refused(values: DataFrame) -> bool:
    """Whether a feed has more than MOST_ITEMS indicators."""
    return values.limit(MOST_ITEMS + 1).count() > MOST_ITEMS
