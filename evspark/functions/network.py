"""IPv4 and IPv6 addresses and blocks by column expressions: 16-byte bounds, canonical text, prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .security import ipv4_range, ipv4_text, let

_GROUP = "[0-9a-f]{1,4}"
_GROUPS = rf"(?:{_GROUP}(?::{_GROUP})*)?"
#: Eight groups, or fewer around one `::`.
_V6 = rf"^(?:{_GROUP}(?::{_GROUP}){{7}}|{_GROUPS}::{_GROUPS})\z"
#: What IPv4 addresses have before them in 16 bytes, and IPv6 addresses may not.
_MAPPED = "0" * 20 + "f" * 4


def _groups(part: Column) -> Column:
    return F.transform(F.filter(F.split(part, ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0"))


def _v6_hex(address: Column) -> Column:
    """32 hexadecimal digits of an IPv6 address; null for any other text."""
    shaped = F.when(address.rlike(_V6), address)
    double = F.contains(shaped, F.lit("::"))
    head, tail = _groups(F.substring_index(shaped, "::", 1)), F.when(double, _groups(F.substring_index(shaped, "::", -1))).otherwise(F.array().cast("array<string>"))

    def filled(g: Column) -> Column:
        n = F.size(g["head"]) + F.size(g["tail"])
        zeros = F.array_repeat(F.lit("0000"), F.greatest(F.lit(8) - n, F.lit(0)))
        return F.when(F.when(g["double"], n <= 7).otherwise(n == 8), F.array_join(F.concat(g["head"], zeros, g["tail"]), ""))

    return F.when(shaped.isNotNull(), let(F.struct(head.alias("head"), tail.alias("tail"), double.alias("double")), filled))


def prefix_hex(digits: Column, bits: Column, fill: str = "0") -> Column:
    """The first `bits` bits of hexadecimal digits, the rest zeros, or ones where fill is `f`."""
    whole = F.floor(bits / 4).cast("int")
    free = F.element_at(F.array(*[F.lit(x) for x in (16, 8, 4, 2)]), F.pmod(bits, F.lit(4)).cast("int") + 1)
    nibble = F.conv(F.substr(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    low = nibble - F.pmod(nibble, free)
    cut = F.lower(F.hex((low if fill == "0" else low + free - 1).cast("long")))
    return F.rpad(F.concat(F.left(digits, whole), F.when(F.pmod(bits, F.lit(4)) > 0, cut).otherwise("")), 32, fill)


def _v6_text(digits: Column) -> Column:
    """Groups without leading zeros; the first longest run of two or more zero groups is `::`."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substr(digits, i * 4 + 1, F.lit(4)), "^0{1,3}", ""))

    def short(text: Column) -> Column:
        runs = [rf"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?::|$)(.*)$" for n in range(8, 1, -1)]
        return F.coalesce(*[F.when(text.rlike(r), F.regexp_replace(text, r, "$1::$2")) for r in runs], text)

    return let(F.array_join(groups, ":"), short)


def ip_range(c: Column) -> Column:
    """start and end as 16-byte values (IPv4 as ::ffff:a.b.c.d), bits (of these 16 bytes, that all addresses of the block share) and the canonical text.

    Host bits of a block are cleared. Null for any other text: zones, netmasks, dotted tails of IPv6 addresses, and IPv4 addresses in
    IPv6 form too, which are to be written as IPv4.
    """

    def block(start: Column, end: Column, bits: Column, text: Column) -> Column:
        return F.struct(F.unhex(start).alias("start"), F.unhex(end).alias("end"), bits.alias("bits"), text.alias("text"))

    def four(x: Column) -> Column:
        digits = lambda n: F.concat(F.lit(_MAPPED), F.lpad(F.hex(n), 8, "0"))
        start, bits = x["block"]["start"], F.coalesce(x["prefix"], F.lit(32))
        text = F.concat(ipv4_text(start), F.when(bits < 32, F.concat(F.lit("/"), bits.cast("string"))).otherwise(""))
        return F.when(x["block"].isNotNull(), block(digits(start), digits(x["block"]["end"]), bits + 96, text))

    def six(x: Column) -> Column:
        def bounds(b: Column) -> Column:
            text = F.concat(_v6_text(b["start"]), F.when(b["bits"] < 128, F.concat(F.lit("/"), b["bits"].cast("string"))).otherwise(""))
            return block(b["start"], b["end"], b["bits"], text)

        bits = F.when(x["size"].isNull(), 128).when(x["prefix"] <= 128, x["prefix"])
        ends = F.struct(prefix_hex(x["digits"], bits).alias("start"), prefix_hex(x["digits"], bits, "f").alias("end"), bits.alias("bits"))
        return F.when(bits.isNotNull() & ~F.startswith(x["digits"], F.lit(_MAPPED)), let(ends, bounds))

    def of(v: Column) -> Column:
        address = F.substring_index(v, "/", 1)
        size = F.when(F.contains(v, F.lit("/")), F.substr(v, F.char_length(address) + 2))
        prefix = F.when(size.rlike(r"^[0-9]{1,3}\z"), size.try_cast("int"))
        of_six = let(F.struct(_v6_hex(address).alias("digits"), size.alias("size"), prefix.alias("prefix")), six)
        return F.when(F.contains(v, F.lit(":")), of_six).otherwise(let(F.struct(ipv4_range(v).alias("block"), prefix.alias("prefix")), four))

    return let(F.lower(F.trim(c)), of)
