"""Personal data: four base kinds by rule, further identifiers by bootstrapped context.

Base spans come from regular expressions and checks of what they match. They are seeds, with white space
inside or not, and so are key-like tokens (KEY: long runs of letters mixed with digits), but for a share that is held
back and treated like any other token. The words around a whole seed
make patterns, and patterns, seeds and the identifier-like tokens that they surround form a graph. Spark scores it in
rounds: a pattern is as trustworthy as the instances that it surrounds, an instance is as likely as its patterns
make it. An instance that is likely enough joins the seeds, and the next round mines patterns anew from all
seeds there are, so contexts that no first seed stands in are learnt as well. What stands in a pattern of high confidence and
is no base span is a new identifier (kind `id`); so a key-like token counts only where the corpus shows it in a
context of such tokens.

Everything is DataFrame expressions. Matches are placed by the lengths of the pieces between
them: split() gives the pieces, regexp_extract_all() the matches. The expressions are those
of the contract, with possessive repeats and an anchor at the start of a run, which change no match but
keep time linear and the stack flat on very long runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_text, documents, Tables

#: The base kinds in their order, and the kind of what the method adds.
KINDS = ("email", "ip", "card", "phone")
ADDED = "id"
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Identifier-like: a token of 6 characters or more with four digits or an @ between other characters.
TOKEN = r"(?<!\S)(?=(?:[^\s0-9]*+[0-9]){4}|\S[^\s@]*+@\S)\S{6,}+"
#: Key-like, of what is left of a token without marks at its ends: 20 characters or more, four digits and four letters among them.
KEY = r"^(?=(?:[^0-9]*+[0-9]){4})(?=(?:[^A-Za-z]*+[A-Za-z]){4})[A-Za-z0-9+/_=-]{20,}+$"


@dataclass(frozen=True)
class Bootstrap:
    """How the graph is scored. A pattern needs `seeds` different seeds and `confidence` to add spans; a token that patterns make
    `accept` likely is a seed from the next round on. Of the key-like tokens the share held_back, by hash, are no first seeds."""

    rounds: int = 4
    seeds: int = 3
    confidence: float = 0.6
    doubt: float = 1.0
    accept: float = 0.6
    held_back: float = 0.0


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def ip_parts(m: Column) -> Column:
    def small(p: Column) -> Column:
        bare = F.regexp_replace(p, "^0+(?=.)", "")
        return (F.length(bare) <= 3) & (F.substring(bare, 1, 3).cast("int") <= 255)

    return F.forall(F.split(m, r"\."), small)


def card_number(m: Column) -> Column:
    d = digits(m)
    return F.length(d).between(14, 19) & F.call_function("luhn_check", F.substring(d, 1, 19))


#: For each kind: its expression, what a text must contain, and the check of a match.
RULES = {
    "email": (EMAIL, lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True)),
    "ip": (IP, lambda t: F.contains(t, F.lit(".")) & t.rlike("[0-9]"), ip_parts),
    "card": (CARD, lambda t: t.rlike("[0-9]"), card_number),
    "phone": (PHONE, lambda t: F.contains(t, F.lit("+")), lambda m: F.length(digits(m)).between(10, 15)),
}
SPAN = "array<struct<start:int,kind:int,stop:int>>"
#: Both hold the text found and its contexts.
SEED = "array<struct<start:int,kind:int,stop:int,token:string,contexts:array<string>>>"
CANDIDATE = "array<struct<start:int,stop:int,token:string,contexts:array<string>>>"
#: What is left of the words beside a match: the rest of its own, and two further words.
BESIDE = r"^\S*+\s*+\S*+\s*+\S*+"


def near(side: Column) -> Column:
    """The rest of a word and two whole words that the text to one side of a match begins with."""
    return F.regexp_replace(F.regexp_extract(side, BESIDE, 0), r"\s+", " ")


def sides(pairs: Column, piece, matched) -> Column:
    """near() of what lies on one side of each match: a piece, then the match before it with its own side."""

    def step(acc: Column, x: Column) -> Column:
        side = near(F.concat(piece(x), acc["m"], F.coalesce(F.try_element_at(acc["out"], F.lit(-1)), F.lit(""))))
        return F.struct(matched(x).alias("m"), F.concat(acc["out"], F.array(side)).alias("out"))

    return F.aggregate(pairs, F.struct(F.lit("").alias("m"), F.array().cast("array<string>").alias("out")), step, lambda acc: acc["out"])


def contexts(before: Column, after: Column) -> Column:
    """Two words before; a word before and one after, of which one has a letter. before is reversed; what touches the match
    is part of neither."""
    two = F.lower(F.reverse(F.regexp_extract(before, r"^\S* (\S+ \S+)", 1)))
    one, following = F.lower(F.reverse(F.regexp_extract(before, r"^\S* (\S+)", 1))), F.lower(F.regexp_extract(after, r"^\S* (\S+)", 1))
    both = F.array(F.when(two != "", F.concat(F.lit("< "), two)), F.when((one != "") & (following != ""), F.concat(one, F.lit(" <> "), following)))
    return F.filter(both, lambda c: c.rlike(r"\p{L}"))


def place(text: Column, pattern: str, build, kind: str) -> Column:
    """build(acc, start, match, contexts) for each match in turn, over an array of type `kind`."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), F.zip_with(found, F.slice(gaps, F.lit(2), F.size(found)), lambda m, after: F.struct(m.alias("m"), after.alias("after"))), lambda gap, x: F.struct(gap.alias("gap"), x["m"].alias("m"), x["after"].alias("after")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["x"]["gap"])
        return F.struct((start + F.length(x["x"]["m"])).alias("at"), build(acc["out"], start, x["x"]["m"], contexts(x["side"]["before"], x["side"]["after"])).alias("out"))

    def run(pairs: Column) -> Column:
        before = sides(pairs, lambda x: F.reverse(x["gap"]), lambda x: F.reverse(x["m"]))
        after = F.reverse(sides(F.reverse(pairs), lambda x: x["after"], lambda x: x["m"]))
        both = F.zip_with(before, after, lambda b, a: F.struct(b.alias("before"), a.alias("after")))
        each = F.zip_with(pairs, both, lambda x, side: F.struct(x.alias("x"), side.alias("side")))
        return F.aggregate(each, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])

    # An array of one, so that the pieces are made once.
    return F.element_at(F.transform(F.array(pieces), run), 1)


def base_seeds(text: Column, kind: str) -> Column:
    """The kind's spans in code points, with contexts; a match that fails its check is dropped and not tried again."""
    pattern, needs, holds = RULES[kind]
    number = KINDS.index(kind)

    def build(out: Column, start: Column, m: Column, around: Column) -> Column:
        seed = F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + F.length(m)).alias("stop"), m.alias("token"), around.alias("contexts"))
        return F.when(holds(m), F.concat(out, F.array(seed))).otherwise(out)

    return F.when(needs(text), place(text, pattern, build, SEED)).otherwise(F.array().cast(SEED))


def candidates(text: Column) -> Column:
    """Identifier-like tokens with their contexts."""

    def build(out: Column, start: Column, m: Column, around: Column) -> Column:
        bare = F.regexp_replace(m, r"^[^\p{L}\p{N}+]+|[^\p{L}\p{N}]+$", "")
        lead = F.length(F.regexp_extract(m, r"^[^\p{L}\p{N}+]+", 0))
        found = F.struct((start + lead).alias("start"), (start + lead + F.length(bare)).alias("stop"), bare.alias("token"), around.alias("contexts"))
        return F.concat(out, F.array(found))

    return F.when(text.rlike("[0-9@]"), place(text, TOKEN, build, CANDIDATE)).otherwise(F.array().cast(CANDIDATE))


def seed_edges(seeds: Column) -> Column:
    """(token, contexts) of each seed. Base spans that overlap are one instance, so they go by the first one's text."""

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["stop"]
        token = F.when(inside, acc["token"]).otherwise(s["token"])
        return F.struct(F.greatest(acc["stop"], s["stop"]).alias("stop"), token.alias("token"), F.concat(acc["out"], F.array(F.struct(token.alias("token"), s["contexts"].alias("contexts")))).alias("out"))

    first = F.struct(F.lit(0).alias("stop"), F.lit("").alias("token"), F.array().cast("array<struct<token:string,contexts:array<string>>>").alias("out"))
    return F.aggregate(seeds, first, step, lambda acc: acc["out"])


def trusted(edges: DataFrame, rule: Bootstrap, tables: Tables | None = None) -> DataFrame:
    """(pattern, confidence) of patterns that may add spans; edges: (pattern, token, seed). The rounds' tables belong to `tables`."""
    tables = tables or Tables(edges.sparkSession)
    # A token counts once for a pattern, however often it stands there.
    pairs = tables.stage(edges.groupBy("pattern", "token").agg(F.max("seed").alias("seed")), "pii-graph")
    scored = pairs.withColumns({"told": F.col("seed"), "score": F.col("seed").cast("double")})
    patterns = None
    for k in range(rule.rounds):
        mined = scored.groupBy("pattern").agg(F.count_if("told").alias("seeds"), (F.sum("score") / (F.count("*") + rule.doubt)).alias("confidence"))
        patterns = tables.stage(mined.where(F.col("seeds") >= rule.seeds).select("pattern", "confidence"), "pii-round")
        if k + 1 < rule.rounds:
            doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))
            tokens = pairs.join(patterns, "pattern").groupBy("token").agg((1 - doubt).alias("likely"))
            joined = pairs.join(tokens, "token", "left").withColumn("told", F.col("seed") | F.coalesce(F.col("likely") >= rule.accept, F.lit(False)))
            scored = tables.stage(joined.withColumn("score", F.when(F.col("told"), 1.0).otherwise(F.coalesce("likely", F.lit(0.0)))).drop("likely"), "pii-round")
    return patterns.where(F.col("confidence") >= rule.confidence)


def first_seed(token: Column, rule: Bootstrap) -> Column:
    """Key-like, and not held back."""
    return token.rlike(KEY) & (F.pmod(F.xxhash64(F.lit("held"), token), F.lit(1000)) >= int(1000 * rule.held_back))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Bootstrap = Bootstrap()) -> DataFrame:
    """(doc_id, base, added), one row per input row: spans (start, kind, stop) in code points, by start and
    kind. kind counts KINDS from 0, added spans have 4.

    A null or empty text has no spans. Null and repeated ids each give their row, an empty table gives
    none, texts are searched whole, and two equal spans cannot arise: base matches of a kind do not
    overlap, and an added span overlaps no base span. Other columns are not read.
    """
    text = F.col("text")
    rows = doc_text(docs, id_col, text_col)
    seeds = F.array_sort(F.concat(*[F.col(k) for k in KINDS]))
    found = rows.select("doc_id", *[base_seeds(text, k).alias(k) for k in KINDS], candidates(text).alias("tokens"))
    found = found.select("doc_id", seeds.alias("seeds"), "tokens").withColumn("base", F.transform("seeds", lambda s: F.struct(s["start"], s["kind"], s["stop"]))).withColumn("row", F.monotonically_increasing_id())
    tables = Tables(docs.sparkSession)
    found = tables.stage(found, "pii-base")
    covered = F.exists("base", lambda s: (s["start"] < F.col("t.stop")) & (s["stop"] > F.col("t.start")))
    each = found.where(F.size("tokens") > 0).select("row", "base", F.explode("tokens").alias("t")).select("row", "t.*", covered.alias("covered")).where(~F.col("covered"))
    # Long tokens and contexts stand in the graph by their hashes.
    edges = each.select("row", "start", "stop", "token", F.explode("contexts").alias("c")).select("row", "start", "stop", F.length("token").alias("size"), F.xxhash64("token").alias("token"), first_seed(F.col("token"), rule).alias("seed"), F.xxhash64("c").alias("pattern"))
    own = found.where(F.size("seeds") > 0).select(F.explode(seed_edges(F.col("seeds"))).alias("t")).select(F.xxhash64("t.token").alias("token"), F.explode("t.contexts").alias("c")).select(F.xxhash64("c").alias("pattern"), "token", F.lit(True).alias("seed"))
    good = trusted(edges.select("pattern", "token", "seed").unionAll(own), rule, tables)
    new = edges.where("size > 0").join(good, "pattern").select("row", F.struct(F.col("start"), F.lit(len(KINDS)).alias("kind"), F.col("stop")).alias("span")).groupBy("row").agg(F.array_sort(F.collect_set("span")).alias("added"))
    out = found.join(new, "row", "left")
    return tables.finish(out.select("doc_id", "base", F.coalesce("added", F.array().cast(SPAN)).alias("added")), "pii-spans")


def written(spans: Column) -> Column:
    """kind:start:end for each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, ADDED)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(documents(spark, sf_dir), rule=Bootstrap(held_back=0.5))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))
