import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from evspark.functions import rules as R
from evspark.functions import security as X
from evspark.functions.network import ip_range


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_numbers(spark):
    texts = ["", "0x10", " 12 ", "12.9", "-12.9", "abc", "1e3", "12 3", None, "　5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(R.to_integer(F.col("t"))).collect()] == [0, 16, 12, 12, -12, None, 1000, None, None, 5]


def test_rule_functions(spark):
    t = F.lit("a1 b22 c333")
    assert one(spark, R.regextract(t, r"[a-z](\d+)"), R.regextract(t, r"x"), R.regextract(F.lit(None).cast("string"), "x")) == (["1", "22", "333"], [], None)
    assert one(spark, R.arrayindex(F.split(t, " "), -1), R.arrayindex(F.split(t, " "), 3), R.arrayindex(F.split(t, " "), -4)) == ("c333", None, None)
    assert one(spark, R.arraycreate(F.lit("x"), F.lit(None).cast("string"), F.lit("y"))) == (["x", "y"],)
    assert one(spark, R.first_filled(F.lit(""), F.lit(None), F.lit("z")), R.replaced(F.lit("a.b.c"), ".", ""), R.trimmed(F.lit("  x "))) == ("z", "abc", "x")
    assert one(spark, R.if_chain(F.lit("0"), F.lit("a"), F.lit(None).cast("string"), F.lit("b"), F.lit("c")), R.if_chain(F.lit("x"), F.lit("a"))) == ("c", "a")
    assert one(spark, R.same(F.lit("5"), F.lit("5.0")), R.same(F.lit("5"), F.lit("5x")), R.same(F.lit(None).cast("string"), F.lit(None).cast("string"))) == (True, False, True)
    assert one(spark, R.nest({"a.b": F.lit("1"), "a.c.d": F.lit("2"), "e": F.lit(None).cast("string")})) == ('{"a":{"b":"1","c":{"d":"2"}}}',)


def test_timestamps(spark):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")
    got = one(
        spark,
        text(R.parse_timestamp("%Y-%m-%dT%H:%M:%E*S", F.lit("2024-02-03T04:05:06.789"))),
        text(R.parse_timestamp("%b %e %H:%M:%S", F.lit("Feb  3 04:05:06"), 2024)),
        text(R.parse_timestamp("%F %T", F.lit("no"))),
    )
    assert got == ("2024-02-03 04:05:06.789", "2024-02-03 04:05:06.000", None)
    with pytest.raises(ValueError):
        R.parse_timestamp("%Q", F.lit(""))


def test_classify(spark):
    cases = {"hxxp://evil[.]com/a": "url", "1.2.3[.]4": "ip", "1.2.3.256": None, "a[@]b.org": "email", "EVIL(.)com": "domain", "d" * 32: "md5", "d" * 40: "sha1", "0" * 64: "sha256", "nothing here": None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert [r[0] for r in df.select(X.classify(F.col("v"))).collect()] == list(cases.values())


def test_candidates(spark):
    raw = "GET http://a.b.example.com/x/y?q=1 from 10.1.2.3, mail Bob@Mail.example.org, " + "ab" * 16
    got = set(one(spark, X.candidates(F.lit(raw)))[0])
    assert {"ip:10.1.2.3", "email:bob@mail.example.org", "md5:" + "ab" * 16} <= got
    assert {f"url:http://a.b.example.com{p}" for p in ("", "/", "/x", "/x/y", "/x/y?q=1")} <= got
    assert {"domain:a.b.example.com", "domain:b.example.com", "domain:example.com", "domain:example.org"} <= got
    assert not any(c.startswith("domain:10.") for c in got)


def test_ranges(spark):
    rnd = random.Random(1)
    values = [f"{rnd.randrange(256)}.{rnd.randrange(256)}.{rnd.randrange(256)}.{rnd.randrange(256)}/{rnd.randrange(33)}" for _ in range(50)] + ["1.2.3.4", "01.2.3.4", "1.2.3", "x", "1.2.3.4/33", None]
    for v, r in zip(values, spark.createDataFrame([(v,) for v in values], "v string").select(X.ipv4_range(F.col("v"))).collect(), strict=True):
        try:
            n = ipaddress.ip_network(v, strict=False)
            assert (r[0].start, r[0].end) == (int(n.network_address), int(n.broadcast_address))
        except ValueError:
            assert r[0] is None
    assert one(spark, X.ipv4_text(F.lit(3232235777))) == ("192.168.1.1",)


def as_python(v):
    """start, end, bits and text by Python's address arithmetic; None for what the library refuses too."""
    if v is None or "%" in v or (":" in v and "." in v):
        return None
    head, _, size = v.strip().partition("/")
    if "/" in v and not (size.isascii() and size.isdigit() and len(size) <= (3 if ":" in v else 2)):
        return None
    try:
        net = ipaddress.ip_network(v.strip(), strict=False)
        mapped = net.version == 6 and ipaddress.ip_address(head).ipv4_mapped
    except ValueError:
        return None
    if mapped:
        return None
    base = 0xFFFF << 32 if net.version == 4 else 0
    ends = [(base + int(a)).to_bytes(16, "big") for a in (net.network_address, net.broadcast_address)]
    whole = net.prefixlen == net.max_prefixlen
    return (*ends, net.prefixlen + (96 if net.version == 4 else 0), str(net.network_address if whole else net))


def test_addresses_of_both_families(spark):
    rnd = random.Random(2)
    group = lambda: rnd.choice(["0", "0", "0", "1", "ffff", f"{rnd.randrange(65536):x}", f"{rnd.randrange(65536):04X}"])
    values = ["2001:DB8::1/32", "::1", "::", "::/0", "1::/16", "10.0.0.1", " 10.0.0.9/8 ", "zz", None, "", ":", ":::", "1:::2", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::3:4:5:6:7:8", "1:2:3:4::5:6:7:8"]
    values += ["12345::", "g::", "::1/129", "::1/", "::1/-1", "::1/ 3", "/3", "::1/3/4", "1.2.3.4/33", "01.2.3.4", "1.2.3", "::ffff:1.2.3.4", "::ffff:102:304", "::fffe:102:304", "fe80::1%eth0", "1.2.3.4/255.0.0.0", "::0:0/12", "1:0:0:2:0:0:0:3", "1:0:0:2:3:0:0:4", "0:0:1::"]
    for _ in range(300):
        head = ":".join(group() for _ in range(rnd.randrange(9)))
        tail = ":".join(group() for _ in range(rnd.randrange(8)))
        text = rnd.choice([head + "::" + tail, ":".join(group() for _ in range(8)), head])
        values.append(text + rnd.choice(["", f"/{rnd.randrange(131)}"]))
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", ip_range(F.col("v")).alias("r"))
    wrong = [(r.v, r.r, as_python(r.v)) for r in df.collect() if (None if r.r is None else (bytes(r.r.start), bytes(r.r.end), r.r.bits, r.r.text)) != as_python(r.v)]
    assert wrong == []
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_tags_of_long_lists(spark):
    from evspark.operators import lists

    names = [f"name {i}" for i in range(500)]
    entries = lambda rows: spark.createDataFrame([(n, None) for n in rows], "value string, expires_at timestamp")
    plain = lists.etag(entries(names), "2026-01-01 00:00:00").first()[0]
    assert plain == __import__("hashlib").sha256("\n".join(sorted(names)).encode()).hexdigest()
    tag = lambda rows: lists.etag(entries(rows).repartition(3), "2026-01-01 00:00:00", 100).first()[0]
    long = tag(names)
    assert long != plain and long == tag(names[::-1] + names[:5])  # whatever the order, repeats are one line
    assert len({long, tag(names[1:]), tag([*names[1:], "other"]), tag([])}) == 4
    grouped = lists.etag(entries(names), "2026-01-01 00:00:00", 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in grouped


def test_severities(spark):
    df = spark.createDataFrame([("critical", 12), ("low", 4), ("odd", 8), (None, 5)], "s string, n int")
    assert [tuple(r) for r in df.select(X.severity_rank(F.col("s")), X.severity_of_level(F.col("n"))).collect()] == [(0, "critical"), (3, "low"), (4, "high"), (4, "medium")]


def test_guards_of_both_families(spark):
    """Against the rules by Python's own address arithmetic."""
    import ipaddress

    from evspark.operators import indicators as N

    values = ["10.0.0.0/7", "8.8.8.8", "127.0.0.1", "224.0.0.0/8", "10.1.2.3", "100.64.1.0/24", "2001:db8::/31", "2001:db8::1", "::1", "ff02::1", "fd00::1", "fe80::/64", "x", "010.1.1.1", "0.0.0.0/1", "::ffff:0:0/96"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for allow in (False, True):
        got = {r.v: r.refused for r in N.refusal_any(df, "v", allow).collect()}
        for v in values:
            try:
                net = ipaddress.ip_network(v, strict=False)
            except ValueError:
                assert got[v] == "no address"
                continue
            meets = lambda blocks: any(b.version == net.version and b.overlaps(net) for b in map(ipaddress.ip_network, blocks))  # noqa: B023,E731
            want = "too wide" if net.prefixlen < N.WIDEST_PREFIX[net.version] else "reserved" if meets(N.NEVER) else "private" if meets(N.PRIVATE_ANY) and not allow else None
            if v != "::ffff:0:0/96":  # IPv4 in IPv6 form is judged as what it holds
                assert got[v] == want, v
