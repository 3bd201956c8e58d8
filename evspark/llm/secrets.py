"""Secret scanning in DataFrame operations: a pattern finds candidates, a random forest removes false ones.

A candidate is a value assigned to a telling name, a token of a known form, or a long run of letters and
digits. Its features are its length, transitions between kinds of characters, kinds and variety of its
characters, how much of it dictionary words cover (the words of a public vocabulary), whether it is part of
a path, and telling words beside it. The forest is Spark's own, fitted on labelled findings (before, value,
after, label). Two sources of these are at hand: `labelled` takes the documents' own candidates that hand-checked
rules settle, at most SAMPLE of them (smallest hashes of their values), and `examples` makes EXAMPLES rows by rule,
for forms that the documents lack; neither grows with the documents. Scoring is a projection: a document's
candidates are exploded in place, nothing is shuffled.

What is found in the documents that are held out (by a checksum of the id) was not learnt from. Their labels are still those
of rules, as no table names the true secrets. What carries over to a form that nothing was learnt of was measured by leaving each
form out of the examples: 95 % and more of cloud, hosting and chat tokens, private keys, hexadecimal values of 18 or 32 digits and values with
marks are still found, but half of the web tokens (the long ones are taken for long runs), half of the mixed runs of 12 to 44 letters and digits,
and of 40 hexadecimal digits only those that are assigned. New forms need labelled findings.

A candidate is the whole value, of any length: an assigned value up to white space, a quote or one of <>,; and in
quotes up to the closing one, a token as far as its characters go, a private key up to its end line.

Null and empty texts have no candidates. Findings carry doc_id, a hash of the text (which tells repeated ids
apart), start (from 1, in code points) and length; repeated rows have their findings each. Very long texts
are scanned whole. An empty table has no findings. Other columns are not read by `findings` and are kept by
`redact`, whatever their names. `redact` masks findings by their place: the same value where it was no finding stays.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from pathlib import Path

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import let, sums_before
from .bpe import default_vocabulary
from .common import BROADCAST_ROWS, cut_lineage, fresh, table

#: A finding counts as a secret from this share of the trees' votes on.
SECRET = 0.5
#: Rows of the made table of labelled findings.
EXAMPLES = 4096
#: Candidates of the documents that are learnt from at most, by each label.
SAMPLE = 10_000
#: Candidates of documents whose crc32 of the id leaves no remainder here are never learnt from: what is found there is held out.
FOLDS = 5
#: Longest value that is learnt from (all are scored).
MOST_LEARNT = 4096
#: Code points before and after a candidate that are looked at.
BESIDE = 40

# Names that secrets are assigned to, and forms of known tokens.
NAMES = "password|passwd|passphrase|pwd|token|secret|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|client[_-]?secret|credentials?"
# A private key block goes up to its end line; where that is missing, as far as lines of a key follow.
PEM = (
    r"-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
    r"(?:(?:[^-]|-(?!----))*+-----END [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
    r"|(?:\s*+(?:Proc-Type|DEK-Info): [^\r\n]*+)*+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{16,}+)*+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]*+={1,2})?)"
)
KNOWN = rf"(?:AKIA|ASIA)[A-Z0-9]{{16}}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{{20,}}+|xox[abprs]-[A-Za-z0-9-]{{10,}}+|eyJ[A-Za-z0-9_-]{{5,}}+\.[A-Za-z0-9_-]{{5,}}+\.[A-Za-z0-9_-]*+|{PEM}"
ASSIGNED = rf"(?i:{NAMES})[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?"
# A quoted value goes up to its closing quote in the same paragraph. Possessive quantifiers: values of any length, without recursion.
QUOTED = "|".join(rf"(?<={q})(?:[^{q}\\\n]|\\[\s\S]|\n(?![ \t\r]*+\n)){{6,}}+(?={q})" for q in "\"'")
CANDIDATE = rf"{KNOWN}|{ASSIGNED}(?:{PEM}|{QUOTED}|[^\s\"'<>,;]{{6,}}+)|(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{{16,}}+"
#: Letters of a dictionary word at least (fewer come up by chance in random text).
LEAST_WORD = 5
# Words beside secrets, and words beside what only looks like one.
NEAR_SECRET = NAMES + "|login|bearer|authorization|signing"
NEAR_OTHER = "sha-?(?:1|256|512)|md5|checksum|digest|commit|revision|uuid|guid|hash|etag|version|build|order|invoice|phone|isbn|serial"
FEATURES = ("length", "transitions", "digits", "upper", "lower", "other", "hex", "variety", "vowels", "dictionary", "path", "assigned", "known", "near_secret", "near_other", "repeats")


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.greatest(F.lit(1), F.char_length(value))


def dictionary(vocabulary: str | None = None) -> list[str]:
    """Words of at least LEAST_WORD letters that begin a word in a vocabulary file of the tokenizers library; its size is the file's."""
    tokens = json.loads(Path(vocabulary or default_vocabulary()).read_bytes())["model"]["vocab"]
    begins = re.compile(rf"\u0120([A-Za-z][a-z]{{{LEAST_WORD - 1},}})")  # U+0120 stands for the space before a word
    return sorted({m[1].lower() for m in map(begins.fullmatch, tokens) if m})


def _covered(column: str, words: list[str]) -> Column:
    """Letters of the words in a column (runs of one kind of letters, or with a capital first) that are in the dictionary."""
    runs = f"regexp_extract_all({column}, '[A-Z]?[a-z]{{{LEAST_WORD - 1},}}|[A-Z]{{{LEAST_WORD},}}', 0)"
    known = ", ".join(f"'{w}'" for w in words) or "null"
    return F.expr(f"aggregate(filter({runs}, w -> lower(w) in ({known})), 0, (n, w) -> n + char_length(w))")


def with_features(found: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """found (before, value, after) and its FEATURES."""
    v, n = F.col("value"), F.greatest(F.lit(1), F.char_length("value"))
    low = F.lower(v)
    has = lambda c, p: c.rlike(p).cast("double")
    changes = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    beside = F.concat(F.lower("before"), F.lit(" "), F.lower("after"))
    columns = {
        "length": F.log1p(n.cast("double")),
        "transitions": _share(v, changes),
        "digits": _share(v, "[0-9]"),
        "upper": _share(v, "[A-Z]"),
        "lower": _share(v, "[a-z]"),
        "other": _share(v, "[^A-Za-z0-9]"),
        "hex": has(v, "^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "variety": F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(64)),  # an alphabet is not larger, however long the value
        "vowels": _share(low, "[aeiou]"),
        "dictionary": _covered("value", dictionary(vocabulary)) / n,
        "path": F.greatest(has(v, r"^[/.~]|/[A-Za-z_.-]{2,}/|\.[a-z]{2,4}$|^[A-Za-z]+(?:[_-][A-Za-z]+)+"), has(F.col("before"), r"[/\\]$|://\S*$")),
        "assigned": has(F.col("before"), rf"(?:{ASSIGNED})$"),
        "known": has(v, KNOWN),  # anywhere: a quoted value may hold more than the token
        "near_secret": has(beside, NEAR_SECRET),
        "near_other": has(F.lower("before"), NEAR_OTHER),
        "repeats": has(v, r"(.)\1{3}|(?:0123|1234|abcd|qwer)"),
    }
    return found.withColumns({k: F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in columns.items()})


def examples(spark: SparkSession, rows: int = EXAMPLES) -> DataFrame:
    """Labelled findings made by rule: before, value, after, label (1: a secret); `rows` of them, all kinds in turn."""
    kinds = _kinds()
    # In a lambda, expressions are evaluated as they are: compiling so many takes longer than running them.
    each = F.expr(f"inline(flatten(transform(array(id), i -> array({', '.join(kinds)}))))")
    return spark.range(0, -(-rows // len(kinds)), 1, 2).select(each).limit(rows)


def _kinds() -> list[str]:
    """In SQL, for a number i, one finding of each kind: struct of before, value, after and label."""
    lit = lambda x: "'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'"
    cat = lambda *xs: f"concat({', '.join(xs)})"
    ws = lambda sep, *xs: f"concat_ws({lit(sep)}, {', '.join(xs)})"
    seed = lambda k, bits: f"sha2(concat({lit(k)}, cast(i as string)), {bits})"
    hexes = lambda k, n: f"substring({seed(k, 256)}, 1, {n})"
    mixed = lambda k, n: f"substring(translate(base64(unhex({seed(k, 512)})), '+/=', 'Qz7'), 1, {n})"
    pick = lambda k, *xs: f"element_at(array({', '.join(lit(x) if isinstance(x, str) else str(x) for x in xs)}), cast(pmod(xxhash64(i, {lit(k)}), {len(xs)}) + 1 as int))"
    long = lambda k, parts, n: f"substring({cat(*[mixed(f'{k}{p}', 86) for p in range(parts)])}, 1, {n})"
    lines = lambda k, parts: ws("\n", *[mixed(f"{k}{p}", 64) for p in range(parts)])
    number = lambda k, n: f"conv({hexes(k, n)}, 16, 10)"
    word = lambda k: pick(k, "report", "order", "photo", "server", "release", "index", "table", "config", "draft", "client")
    name = pick("n", "password", "token", "secret", "api_key", "passwd", "access-key", "client_secret", "pwd", "credential", "auth_key")
    sep = pick("s", "=", " = ", ": ", ":", '="', ' = "', ': "', "='")
    prose = pick("p", "the of and ", "it was on ", "and here. ", "see ", "is used with ", "")
    assigned = cat(prose, name, sep)
    opaque = cat(prose, pick("ta", "Authorization: Bearer ", "authorization: bearer ", "the password is ", "login with ", "my secret token is ", "SIGNING KEY ", "API_KEY ", "private_key\n", "the passphrase was ", "credentials "))
    telling = cat(prose, pick("tb", "login page ", "the password policy of ", "one token of ", "a secret in ", "authorization for ", "credentials in "))
    quoted = cat(prose, name, pick("u", '="', ' = "', ': "', "='"))
    true = [
        (prose, cat(lit("AKIA"), f"upper({mixed('a', 16)})")),
        (assigned, cat(lit("AKIA"), f"upper({mixed('b', 16)})")),
        (assigned, hexes("c", 18)),
        (assigned, hexes("d", 40)),
        (assigned, cat(hexes("e", 8), hexes("f", 24))),
        (assigned, mixed("g", 24)),
        (assigned, mixed("h", 44)),
        (prose, cat(lit("ghp_"), mixed("i", 36))),
        (prose, cat(lit("eyJ"), mixed("j", 30), lit("."), mixed("k", 60), lit("."), mixed("l", 43))),
        (assigned, cat(mixed("m", 7), pick("y", "!", "#", "$", "%", "&"), mixed("o", 5))),
        (assigned, mixed("q", 12)),
        (prose, cat(lit("xoxb-"), number("r", 10), lit("-"), mixed("t", 24))),
        (assigned, long("la", 8, pick("lb", 100, 200, 400, 600))),
        (prose, cat(lit("eyJ"), mixed("lc", 30), lit("."), long("ld", 8, pick("le", 100, 200, 400, 600)), lit("."), mixed("lf", 43))),
        (pick("lg", "", "private_key: ", 'private_key = "'), cat(lit("-----BEGIN "), pick("lh", "", "RSA ", "EC "), lit("PRIVATE KEY-----\n"), lines("li", 8), lit("\n-----END PRIVATE KEY-----"))),
        (quoted, cat(mixed("qa", 5), pick("qb", ",", ";", "<", ">", " ", ", "), mixed("qc", 8), pick("qd", "", "!", "#", ";"), mixed("qe", 4))),
        (opaque, mixed("tc", 20)),
        (opaque, mixed("td", 43)),
        (opaque, hexes("te", 32)),
        (opaque, hexes("tf", 40)),
        (opaque, long("tg", 4, pick("th", 64, 100, 200, 300))),
    ]
    other = pick("o", "sha256 ", "checksum: ", "commit ", "md5 ", "digest=", "revision ", "hash ", "build ", "etag: ")
    false = [
        (cat(prose, other), hexes("A", 64)),
        (cat(prose, other), hexes("B", 40)),
        (prose, hexes("C", 32)),
        (prose, hexes("D", 64)),
        (cat(prose, lit("uuid ")), cat(hexes("E", 8), lit("-"), hexes("F", 4), lit("-"), hexes("G", 4), lit("-"), hexes("H", 4), lit("-"), hexes("I", 12))),
        (cat(prose, lit("/")), ws("/", word("J"), word("K"), cat(word("L"), hexes("M", 2)))),
        (prose, ws("_", word("N"), word("O"), cat(lit("v"), pick("P", "1", "2", "3", "10")), word("Q"))),
        (assigned, pick("R", "changeme", "example123", "YOUR_TOKEN_HERE", "xxxxxxxxxxxx", "placeholder", "dummy-password-1", "default", "insert-your-key-here", "********", "<your-password>", "null-value", "testtest1234")),
        (assigned, ws("-", word("S"), word("T"), word("U"))),
        (prose, f"lpad({number('V', 13)}, 16, '4')"),
        (cat(prose, lit("https://www.example.com/")), ws("-", word("W"), word("X"), number("Y", 5))),
        (prose, cat(word("Z"), word("1"), word("2"), pick("3", "1", "2", "2021", "2024"))),
        (prose, long("na", 8, pick("nb", 100, 200, 400, 600))),
        (quoted, pick("nc", "please enter your password here", "the name of the client, not the value", "your secret goes here", "is not set; see the config file", "must be changed after the release", "<insert your token here>", "change this value, please")),
        (cat(telling, other), hexes("nd", 40)),
        (cat(telling, other), hexes("ne", 64)),
        (telling, ws("_", word("nf"), word("ng"), cat(lit("v"), pick("nh", "1", "2", "3", "10")), word("ni"))),
        (telling, ws("-", word("nj"), word("nk"), pick("nl", "2019", "2021", "2024"), pick("nm", "01-31", "12-05"))),
        (cat(telling, lit("uuid ")), ws("-", hexes("nn", 8), hexes("nx", 4), hexes("np", 4), hexes("nq", 4), hexes("nr", 12))),
    ]
    kinds = [(b, v, label) for group, label in ((true, 1), (false, 0)) for b, v in group]
    after = """case when i % 3 = 0 then '" and then' else ' and then' end"""
    return [f"struct({b} as before, {v} as value, {after} as after, {label} as label)" for b, v, label in kinds]


def held_out() -> Column:
    """Whether a candidate's document is one of those that are never learnt from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == 0


def labelled(found: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Candidates that hand-checked rules settle, with label 1 or 0: at most `sample` of each, by the smallest hashes of value and place.

    A secret is a key or token of a known form, or an opaque value (digits and letters mixed, no word of four letters, 16 or more)
    that is assigned in quotes to a telling name. None is a bare number of 12 to 19 digits, a placeholder, a digest named so
    beside it, or a path. All others have no label and are not learnt from, nor is what is held out.
    """
    v = F.col("value")
    quoted = F.col("before").rlike(r"[\"']$") & F.left("after", F.lit(1)).isin('"', "'")
    opaque = v.rlike(r"^[A-Za-z0-9+/=_-]{16,}$") & v.rlike("[0-9].*[0-9].*[0-9]") & v.rlike("[A-Za-z].*[A-Za-z]") & ~F.lower(v).rlike("[g-z]{4}") & ~v.rlike(r"(.)\1{4}")
    placeholder = F.lower(v).rlike(r"^(?:change.?me|your\b.*|example.*|placeholder|dummy.*|x{6,}|\*{6,}|<.*>)$")
    named = F.lower("before").rlike(rf"(?:{NEAR_OTHER})\W{{0,3}}$") & v.rlike("^[0-9a-f]{32,}$")
    label = (
        F.when(placeholder, 0)
        .when(F.col("kind") == "known", 1)
        .when((F.col("kind") == "assigned") & quoted & opaque, 1)
        .when((F.col("kind") == "token") & (v.rlike(r"^[0-9]{12,19}$") | named | v.rlike(r"^/?(?:[a-z._-]{2,20}/){2,}[a-z._-]{2,20}[0-9]{0,4}$")), 0)
    )
    found = found.filter((F.char_length("value") <= MOST_LEARNT) & ~held_out())
    rows = found.select("before", "value", "after", label.alias("label"), F.xxhash64("value", "doc_id", "start").alias("order")).filter(F.col("label").isNotNull())
    each = [rows.filter(F.col("label") == k).orderBy("order", "value", "before", "after").limit(sample) for k in (1, 0)]
    return each[0].unionByName(each[1]).drop("order")


def fit(findings: DataFrame, *, trees: int = 24, depth: int = 8, seed: int = 11, vocabulary: str | None = None) -> RandomForestClassificationModel:
    """A forest on labelled findings: before, value, after and label (0 or 1; others are left out)."""
    rows = findings.filter(F.col("label").isin(0, 1) & F.col("value").isNotNull()).withColumns({c: F.coalesce(c, F.lit("")) for c in ("before", "after")})
    # Cut here, so that the features aren't planned for each of the tables that the findings are put together from.
    rows = with_features(cut_lineage(rows.select("before", "value", "after", "label")), vocabulary)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.withColumn("label", F.col("label").cast("double")))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="0.4").fit(cut_lineage(vectors.select("features", "label")))


def fit_for(found: DataFrame) -> RandomForestClassificationModel:
    """A forest on the settled ones of these candidates and on the made examples."""
    made = examples(found.sparkSession)
    return fit(labelled(found).unionByName(made))


def _parts(text: Column) -> tuple[Column, Column]:
    """The candidates of a text with the names that they are assigned to, and the gaps before, between and after them."""
    return F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE, -1)


def _head(hit: Column) -> Column:
    """The part of a hit before its value."""
    return F.when(hit.rlike(rf"^(?:{KNOWN})"), F.lit("")).otherwise(F.regexp_extract(hit, rf"^(?:{ASSIGNED})", 0))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, place (among the text's candidates, from 0), before, value, after, start and kind of every candidate."""
    some = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").filter(F.col("text").rlike(CANDIDATE))
    hits, gaps = _parts(F.col("text"))
    cut = some.select("doc_id", "text_key", hits.alias("hits"), gaps.alias("gaps"))
    # Where each hit starts: the lengths of all gaps and hits before it.
    size = F.zip_with("gaps", "hits", lambda g, h: (F.char_length(g) + F.coalesce(F.char_length(h), F.lit(0))).cast("long"))

    def candidate(hit: Column, i: Column, gaps: Column, before: Column) -> Column:
        at = (F.get(before, i) + F.char_length(F.get(gaps, i)) + 1).cast("int")
        return F.struct(i.alias("place"), hit.alias("hit"), at.alias("at"), F.right(F.get(gaps, i), F.lit(BESIDE)).alias("left"), F.left(F.get(gaps, i + 1), F.lit(BESIDE)).alias("after"))

    each = let(F.col("gaps"), lambda gaps: let(sums_before(size), lambda before: F.transform("hits", lambda hit, i: candidate(hit, i, gaps, before))))
    each = cut.select("doc_id", "text_key", F.explode(each).alias("c")).select("doc_id", "text_key", "c.*").withColumn("head", _head(F.col("hit")))
    value = F.substr("hit", F.char_length("head") + 1)
    kind = F.when(value.rlike(rf"^(?:{KNOWN})"), "known").when(F.col("head") != "", "assigned").otherwise("token")
    return each.select("doc_id", "text_key", "place", F.concat("left", "head").alias("before"), value.alias("value"), "after", (F.col("at") + F.char_length("head")).alias("start"), kind.alias("kind"))


def scored(found: DataFrame, model: RandomForestClassificationModel, vocabulary: str | None = None) -> DataFrame:
    """Candidates with their score and whether they are secrets."""
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(found, vocabulary))
    rated = model.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    return rated.select("doc_id", "text_key", "place", "start", F.char_length("value").alias("length"), "kind", "value", "score", (F.col("score") >= SECRET).alias("secret"))


def findings(docs: DataFrame, model: RandomForestClassificationModel, vocabulary: str | None = None) -> DataFrame:
    """Every candidate with its score and whether it is a secret."""
    return scored(candidates(docs), model, vocabulary)


def redact(docs: DataFrame, model: RandomForestClassificationModel, mask: str = "[SECRET]", found: DataFrame | None = None) -> DataFrame:
    """docs with every secret replaced by mask where it was found; n_chars, if there is one, follows the text. found: the candidates of docs, if they are at hand."""
    found = scored(candidates(docs) if found is None else found, model)
    s_id, s_key, s_flags = fresh(docs, "s_id", "s_key", "s_flags")
    # In order of place, a flag for each of a text's candidates; repeated rows have the same ones.
    of = found.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("place", "secret"))).alias("flags"))
    of = of.filter(F.exists("flags", lambda f: f["secret"])).select(F.col("doc_id").alias(s_id), F.col("text_key").alias(s_key), F.transform("flags", lambda f: f["secret"]).alias(s_flags))
    of = cut_lineage(of)  # read twice; a row for each document that has secrets
    small = of.agg(F.coalesce(F.sum(F.size(s_flags) + F.lit(16)), F.lit(0))).first()[0] <= 16 * BROADCAST_ROWS  # bytes
    both = docs.join(F.broadcast(of) if small else of, F.col("doc_id").eqNullSafe(F.col(s_id)) & (F.xxhash64("text") == F.col(s_key)), "left")
    hits, gaps = _parts(F.col("text"))
    kept = let(F.col(s_flags), lambda flags: F.transform(hits, lambda h, i: F.when(F.get(flags, i), F.concat(_head(h), F.lit(mask))).otherwise(h)))
    masked = F.array_join(F.zip_with(gaps, kept, lambda g, h: F.concat(g, F.coalesce(h, F.lit("")))), "")
    out = both.withColumn("text", F.when(F.col(s_flags).isNull(), F.col("text")).otherwise(masked))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(s_flags).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut_lineage(candidates(table(spark, sf_dir, "documents")))  # learnt from and scored
    return scored(found, fit_for(found)).select(
        held_out().alias("held_out"), F.col("doc_id").cast("long").alias("doc_id"), "start", "length", "kind", F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), "secret"
    )
