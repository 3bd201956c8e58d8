"""Ten events of one tenant and one of another, with every kind of value a document can have."""

from datetime import datetime, timedelta

T0 = datetime(2026, 10, 1)
ROWS = [
    (1, "syslog", "c1", "Failed password for invalid user admin from 203.0.113.9", '{"host":"web01","app_name":"sshd","bytes":100,"xdm":{"source":{"ipv4":"203.0.113.9"},"event":{"outcome":"FAILED"}}}'),
    (2, "syslog", "c1", "Accepted publickey for ash", '{"host":"web01","app_name":"sshd","bytes":"2500","xdm":{"source":{"ipv4":"10.0.0.5"},"event":{"outcome":"SUCCESS"}}}'),
    (3, "syslog", "c2", "sudo: bob : COMMAND=/bin/ls", '{"host":"web02","app_name":"sudo","bytes":12.5}'),
    (4, "syslog", None, "no host here", "{}"),
    (5, "mac", "c3", "XProtect FAILED scan", '{"host":"mbp","app_name":"xprotect","tags":["a","b"],"ok":true,"bytes":"abc"}'),
    (6, "mac", "c3", "UPPER and lower CaSe", '{"host":"MBP","nested":{"list":[{"k":"v0"},{"k":"v1"}]},"none":null,"bytes":-3}'),
    (7, "router", "c4", "dhcp 100%_done\\ back\\slash", '{"host":"rtr","app_name":"dnsmasq","bytes":0}'),
    (8, "syslog", "c1", "Grüße aus Zürich 日本", '{"host":"web01","app_name":"cron","bytes":1000}'),
    (9, "syslog", "c1", "no event time", '{"host":"web03","app_name":"cron","bytes":"7"}'),
    (10, "syslog", "c1", "dup host", '{"host":"web01","app_name":"sshd","bytes":5}'),
]


def events(spark):
    from evspark.sources.envelope import SCHEMA

    rows = []
    for n, source, collector, raw, parsed in ROWS:
        at = T0 + timedelta(minutes=10 * n)
        rows.append((f"{n:02d}", "a", source, collector, at, None if n == 9 else at - timedelta(minutes=3), raw, parsed))
    other = '{"host":"web01","app_name":"sshd","bytes":1,"user-agent":"x","2fa":"y","dataset":"d","_time":"t"}'
    rows.append(("11", "b", "syslog", "cx", T0 + timedelta(minutes=55), T0 + timedelta(minutes=52), "other tenant web01", other))
    return spark.createDataFrame(rows, SCHEMA)
