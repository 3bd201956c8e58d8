"""Functions of ingest rules as Column expressions. Values are text; conditions are two-valued."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_MATCHES = 20
# Fixed value: characters that trimming removes besides ASCII white space.
_SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_NUMERIC = r"^-?[0-9]+(\.[0-9]+)?\z"


def truthy(c: Column) -> Column:
    """Not null, '', '0' or 'false'."""
    return F.coalesce(~c.cast("string").isin("", "0", "false"), F.lit(False))


def if_chain(*parts: Column) -> Column:
    """if(condition, value, condition, value, ..., otherwise); conditions may be boolean or text."""
    pairs, last = parts[: len(parts) // 2 * 2], parts[-1] if len(parts) % 2 else F.lit(None)
    chain = F.when(truthy(pairs[0]), pairs[1])
    for i in range(2, len(pairs), 2):
        chain = chain.when(truthy(pairs[i]), pairs[i + 1])
    return chain.otherwise(last)


def first_filled(*values: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+\\z", "")


def to_number(c: Column) -> Column:
    """Number of a text: empty is 0, 0x.. is hexadecimal, anything else that is no number is null."""
    t = trimmed(c)
    return (
        F.when(t == "", F.lit(0.0))
        .when(t.rlike(r"^0[xX][0-9a-fA-F]{1,15}\z"), F.conv(F.substring(t, 3, 15), 16, 10).try_cast("double"))
        .when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), t.try_cast("double"))
    )


def to_integer(c: Column) -> Column:
    n = to_number(c)
    return F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("long")


def regextract(c: Column, pattern: str) -> Column:
    """At most 20 matches: the first group, or the whole without one; none is an empty array, null stays null."""
    return F.slice(F.regexp_extract_all(clamped(c), F.lit(pattern), F.lit(1 if re.compile(pattern).groups else 0)), 1, MOST_MATCHES)


def arrayindex(a: Column, i: int) -> Column:
    """Null out of range; negative counts from the end."""
    return F.get(a, F.lit(i) if i >= 0 else F.size(a) + i)


def arraycreate(*values: Column) -> Column:
    return F.array_compact(F.array(*values))


def replaced(c: Column, old: str, new: Column | str) -> Column:
    return F.replace(c, F.lit(old), F.coalesce(F.lit(new) if isinstance(new, str) else new, F.lit("")))


def same(a: Column, b: Column) -> Column:
    """Equal as numbers if both look like numbers, else as text; null equals null."""
    numeric = F.coalesce(a.rlike(_NUMERIC) & b.rlike(_NUMERIC), F.lit(False))
    return F.when(numeric, a.try_cast("double") == b.try_cast("double")).otherwise(a.eqNullSafe(b))


def less(a: Column, b: Column, or_equal: bool = False) -> Column:
    """Ordered as numbers if both look like numbers, else as text; false where one is null."""
    numeric = F.coalesce(a.rlike(_NUMERIC) & b.rlike(_NUMERIC), F.lit(False))
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.coalesce(F.when(numeric, x <= y if or_equal else x < y).otherwise(a <= b if or_equal else a < b), F.lit(False))


def more(a: Column, b: Column, or_equal: bool = False) -> Column:
    return less(b, a, or_equal)


def differs(a: Column, b: Column) -> Column:
    """Exactly the opposite of `same`."""
    return ~same(a, b)


def holds(a: Column, part: Column) -> Column:
    """A literal substring, whatever its case; false where one is null."""
    return F.coalesce(F.contains(F.lower(a), F.lower(part)), F.lit(False))


#: Characters of a text that rule patterns look at.
MOST_SUBJECT = 4096


def clamped(c: Column) -> Column:
    return F.left(c, F.lit(MOST_SUBJECT))


def fits(a: Column, pattern: str) -> Column:
    """A pattern anywhere in the text, case-sensitive; false for null."""
    return F.coalesce(clamped(a).rlike(pattern), F.lit(False))


def among(a: Column, *values: Column) -> Column:
    """Equal, as `same` means it, to one of the values."""
    hit = F.lit(False)
    for v in values:
        hit = hit | same(a, v)
    return hit


def negated(c: Column) -> Column:
    """True for what isn't true, so for null too."""
    return ~truthy(c)


def to_string(c: Column, kind: str = "text") -> Column:
    """Text of a value; of an array or object (kind `json`) its JSON text."""
    return F.when(c.isNotNull(), F.to_json(c)) if kind == "json" else c.cast("string")


def length(c: Column) -> Column:
    """UTF-16 units of a text: characters beyond the basic plane count twice."""
    return F.char_length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def array_length(a: Column) -> Column:
    """Elements of an array, null for null."""
    return F.when(a.isNotNull(), F.size(a))


# Strftime codes, what text each stands for, and names of months.
_FORMS = {
    "%Y": r"(?<Y>\d{4})", "%m": r"(?<m>\d{1,2})", "%d": r"(?<d>\d{1,2})", "%e": r"\s*(?<d>\d{1,2})", "%H": r"(?<H>\d{2})", "%M": r"(?<M>\d{2})", "%S": r"(?<S>\d{2})",
    "%b": r"(?<b>[A-Za-z]{3})", "%f": r"(?<S>\d{2}(?:\.\d+)?)", "%E*S": r"(?<S>\d{2}(?:\.\d+)?)", "%Z": r"(?<Z>Z|[+-]\d{2}:?\d{2})", "%z": r"(?<Z>Z|[+-]\d{2}:?\d{2})", "%Ez": r"(?<Z>Z|[+-]\d{2}:?\d{2})",
}
_WIDE = {"%F": "%Y-%m-%d", "%T": "%H:%M:%S"}
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def parse_timestamp(fmt: str, c: Column, year: int | None = None) -> Column:
    """Timestamp of a text in a strftime format, null if it doesn't fit. White space around it is ignored, months and days may have one digit.

    Without a year in the format, `year` (else the current one) is meant; without a zone, UTC. Fractions are kept to milliseconds.
    """
    for short, long in _WIDE.items():
        fmt = fmt.replace(short, long)
    pieces = re.findall(r"%E\*S|%Ez|%[A-Za-z]|[^%]+|%", fmt)
    if unknown := [p for p in pieces if p.startswith("%") and p not in _FORMS]:
        raise ValueError(f"unknown format codes {unknown}")
    codes = [re.search(r"\?<(\w)>", _FORMS[p])[1] for p in pieces if p in _FORMS]
    pattern = "".join(re.sub(r"\?<\w>", "", _FORMS[p]) if p in _FORMS else re.sub(r"[^\w\s]", r"\\\g<0>", p) for p in pieces)
    pattern = rf"^\s*{pattern}\s*\z"
    # All parts come from one match: `place` tells the last group of each code.
    place = {k: i + 1 for i, k in enumerate(codes)}
    marked = F.split(F.regexp_replace(c, pattern, "\u0001" + "\u0001".join(f"${i + 1}" for i in range(len(codes)))), "\u0001")
    part = lambda k, other: F.get(marked, F.lit(place[k])) if k in place else F.lit(other)
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(part("b", ""))).cast("string") if place.get("b", 0) > place.get("m", 0) else part("m", "1")
    own_year = part("Y", str(year)) if "Y" in place or year else F.year(F.current_timestamp()).cast("string")
    two = lambda x: F.lpad(x, 2, "0")
    seconds = F.regexp_extract(part("S", "0"), r"^(\d+(?:\.\d{1,3})?)", 1)
    seconds = F.concat(two(F.regexp_extract(seconds, r"^(\d+)", 1)), F.regexp_extract(seconds, r"(\.\d+)$", 1))
    zone = F.regexp_replace(part("Z", "Z"), r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
    iso = F.concat(F.lpad(own_year, 4, "0"), F.lit("-"), two(month), F.lit("-"), two(part("d", "1")), F.lit("T"), two(part("H", "0")), F.lit(":"), two(part("M", "0")), F.lit(":"), seconds, zone)
    return F.when(c.rlike(pattern), F.try_to_timestamp(iso))


def nest(fields: dict[str, Column]) -> Column:
    """JSON document of dotted names: the parts of a name become nested objects; nulls are left out."""
    tree: dict = {}
    for name, c in fields.items():
        at = tree
        *parents, leaf = name.split(".")
        for p in parents:
            at = at.setdefault(p, {})
        at[leaf] = c

    def struct(node: dict) -> Column:
        return F.struct(*[(struct(v) if isinstance(v, dict) else v).alias(k) for k, v in node.items()])

    return F.to_json(struct(tree))
