import hashlib

import duckdb
import pytest

from evspark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, mask string, i int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


ROWS = [
    (1, 0, "user", "a & b <| c &lt;| &amp;", "x", 1),
    (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\nhi<|im_turn|>", "x", 1),
    (1, 2, "assistant", None, "x", 1),
    (1, 3, "assistant", "é\n\n日本 🙂", "x", 1),
    (2, 1, None, "tie", "x", 1),
    (2, 1, None, "tie", "x", 1),
    (2, None, "assistant", "first<", "x", 1),
    (3, 5, "ro\nle<|im_end|>\n&#10;", "", "x", 1),
    (4, 0, "assistant", "&#10;" * 3, "x", 1),
    (None, 0, "user", "no id", "x", 1),
]


def order(r):
    return [(v is not None, v if v is not None else 0) for v in (r[1],)] + [(r[2] or ""), (r[3] or "")]


def test_round_trip(spark):
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(ROWS, SCHEMA))).collect()}
    for conv in {r[0] for r in ROWS}:
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in ROWS if r[0] == conv), key=order)]
        assert [tuple(t) for t in got[conv].turns] == want
        f = got[conv].formatted
        for (role, text), m in zip(want, got[conv].mask, strict=True):
            span = f[m.start : m.start + m.length]
            assert span.replace("&lt;|", "<|").replace("&amp;", "&") == text
            assert m.loss == (role == "assistant")
        assert f.count("<|im_start|>") == f.count("<|im_end|>\n") == sum(i == 0 or want[i - 1][0] != want[i][0] for i in range(len(want)))


def test_digests(spark):
    got = {r.conv_id: r for r in chat.digests(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    for conv in {r[0] for r in ROWS}:
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in ROWS if r[0] == conv), key=order)]
        loss = "".join(t for role, t in want if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(want), len(loss))
        assert r.turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in want)) and r.loss_sha256 == sha(loss)
    assert chat.digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_loss_is_read_under_the_mask(spark):
    """A mask that is shifted, or shorter, gives another text."""
    chats = chat.format_chats(spark.createDataFrame(ROWS, SCHEMA).filter("conv_id = 1")).cache()
    read = lambda df: df.select(chat.F.array_join(chat.under_mask(), "").alias("x")).first().x
    right = read(chats)
    assert right == "<|im_end|>\n<|im_start|>user\nhi<|im_turn|>" + "é\n\n日本 🙂"
    for change in ("transform(mask, m -> struct(m.start + 1 as start, m.length as length, m.loss as loss))", "transform(mask, m -> struct(0L as start, m.length as length, m.loss as loss))", "transform(mask, m -> struct(m.start as start, m.length - 1 as length, m.loss as loss))", "transform(mask, m -> struct(m.start as start, m.length as length, not m.loss as loss))"):
        assert read(chats.withColumn("mask", chat.F.expr(change))) != right


def test_many_turns(spark):
    """More turns than a chunk holds, in runs of every length, across chunks' borders."""
    roles = ["user" if i % 7 < 3 or 200 < i < 700 else "assistant" for i in range(1500)]
    turns = [(1, i, r, f"{i} <| & {'x' * (i % 13)}") for i, r in enumerate(roles)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    r = chat.digests(df).first()
    loss = "".join(t for _, _, role, t in turns if role == "assistant")
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (1500, len(loss), sha(loss)) and r.turns_sha256 == sha("".join(f"{a}\n{b}\n" for _, _, a, b in turns))
    f = chat.format_chats(df).first().formatted
    assert f.count("<|im_start|>") == sum(i == 0 or roles[i - 1] != roles[i] for i in range(1500))


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{d}/conversations.parquet'")
    want = sorted(con.execute(chat.SQL).fetchall())
    assert sorted(map(tuple, chat.query(spark, d).collect())) == want
