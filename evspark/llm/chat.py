"""Chat formatting with Spark expressions only: sorted turn structs become one marked text per conversation.

The turns of a conversation are collected as structs and sorted. A fold over them (`aggregate`) merges adjacent turns of
one role into blocks; it runs over CHUNK turns at a time, since a fold copies what it has gathered at every step, and
blocks that meet at a chunk's border are written as one. All blocks are then joined into the text.

Template. A run of adjacent turns with one role is a block ``<|im_start|>ROLE\\n...<|im_end|>\\n``; the
turns of a block are joined by ``<|im_turn|>``, so that merging loses no boundary. Inside texts and roles
``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|`` (in roles a newline also becomes ``&#10;``), so no
marker can come from a text and the escapes can be undone. The loss mask has a span for every turn, in
code points of the formatted text, with a flag that is true for the roles that are trained on; the text
that is trained on is cut from the formatted text by these spans.

Turns are ordered by (turn, role, text), nulls first, so that ties and repeated rows have one order. A
null text is empty, a null role is ''. Rows with a null conversation id form one conversation. An empty
table gives an empty result. Other columns are not read. A conversation is one output row, so its own text
has to fit in a task; different conversations are spread by their id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import before, chunks, let, sums_before
from .common import table

# The template's markers.
START, END, TURN = "<|im_start|>", "<|im_end|>\n", "<|im_turn|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("&#10;"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("&#10;"), F.lit("\n")))


def _merged(turns: Column) -> Column:
    """Blocks (role, bodies) of adjacent turns of one role, from sorted turns (role, body)."""
    block = "struct<role:string,bodies:array<string>>"

    def step(blocks: Column, t: Column) -> Column:
        # The block that is open lies beside the ones that are done, so that a step doesn't copy these.
        opened, done = blocks["open"], blocks["done"]
        own = F.struct(t["role"].alias("role"), F.array(t["body"]).alias("bodies"))
        longer = F.struct(t["role"].alias("role"), F.concat(opened["bodies"], F.array(t["body"])).alias("bodies"))
        same = F.coalesce(opened["role"] == t["role"], F.lit(False))
        closed = F.when(same | opened.isNull(), done).otherwise(F.concat(done, F.array(opened)))
        return F.struct(closed.alias("done"), F.when(same, longer).otherwise(own).alias("open"))

    start = F.struct(F.array().cast(f"array<{block}>").alias("done"), F.lit(None).cast(block).alias("open"))
    return F.aggregate(turns, start, step, lambda blocks: F.concat(blocks["done"], F.array(blocks["open"])))


def format_chats(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted and mask: array of (start, length, loss), one per turn, start from 0."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))  # nulls come first
    chats = chats.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), escape(t["text"]).alias("body"))).alias("t"))
    chats = chats.select("conv_id", F.flatten(chunks(F.col("t"), lambda part, _: _merged(part))).alias("blocks"))
    of = lambda i: F.get("blocks", i)["role"]

    def piece(b: Column, i: Column) -> Column:
        opens, closes = ~of(i - 1).eqNullSafe(b["role"]), ~of(i + 1).eqNullSafe(b["role"])
        head = F.when(opens, F.concat(F.lit(START), escape_role(b["role"]), F.lit("\n"))).otherwise(F.lit(TURN))
        return F.struct(
            head.alias("head"),
            F.array_join(b["bodies"], TURN).alias("body"),
            F.when(closes, F.lit(END)).otherwise(F.lit("")).alias("tail"),
            F.transform(b["bodies"], lambda x: F.char_length(x)).alias("sizes"),
            b["role"].isin(*trained).alias("loss"),
        )

    chats = chats.select("conv_id", F.transform("blocks", piece).alias("p"))
    size = F.transform("p", lambda p: F.char_length(p["head"]) + F.char_length(p["body"]) + F.char_length(p["tail"]))

    def spans(p: Column, at: Column) -> Column:
        steps = F.transform(p["sizes"], lambda n: n + len(TURN))
        spans_of = lambda start: F.zip_with(before(steps), p["sizes"], lambda past, n: F.struct((start + past).alias("start"), n.cast("long").alias("length"), p["loss"].alias("loss")))
        return let(at + F.char_length(p["head"]), spans_of)

    return chats.select(
        "conv_id",
        F.array_join(F.transform("p", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        F.flatten(F.zip_with("p", let(size, sums_before), spans)).alias("mask"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, formatted, mask and, parsed from `formatted`, turns: array of (role, text)."""
    blocks = F.split("formatted", "<\\|im_end\\|>\n")

    def turns_of(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.char_length(head) + F.lit(2))
        role = unescape_role(F.substr(head, F.lit(len(START) + 1)))
        return F.transform(F.split(body, "<\\|im_turn\\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    full = F.filter(blocks, lambda b: b != "")
    return chats.withColumn("turns", F.flatten(F.transform(full, turns_of)))


def under_mask(formatted: str = "formatted", mask: str = "mask") -> Column:
    """The texts of the flagged spans of the mask, cut from the formatted text and unescaped, in order."""
    flagged = F.filter(F.col(mask), lambda m: m["loss"])

    def cut(part: Column, _: Column) -> Column:
        first, last = F.get(part, F.lit(0)), F.get(part, F.size(part) - 1)
        # A place in a text is found by counting from its beginning: the stretch of these spans is cut out first.
        stretch = F.substr(F.col(formatted), (first["start"] + 1).cast("int"), (last["start"] + last["length"] - first["start"]).cast("int"))
        return let(stretch, lambda s: F.transform(part, lambda m: unescape(F.substr(s, (m["start"] - first["start"] + 1).cast("int"), m["length"].cast("int")))))

    return let(flagged, lambda some: F.flatten(chunks(some, cut)))


def digests(turns: DataFrame) -> DataFrame:
    read = read_back(format_chats(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(under_mask(), "")
    return read.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(control).alias("text"),
    )
    return digests(turns.unionByName(extra))


#: DuckDB: the same digests from the rows; the formatted length follows from the template.
SQL = """
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), o as (
  select *, row_number() over w as i, lag(role) over w as before, lead(role) over w as after
  from t window w as (partition by conv_id order by turn nulls first, role, text)
), s as (
  select *, length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|'))
    + case when before is distinct from role then 13 + length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;')) else 11 end
    + case when after is distinct from role then 11 else 0 end as size
  from o
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(size) as bigint) as formatted_chars
from s group by conv_id
"""
