"""Bootstrapped contextual extraction of personal data.

Regular expressions give base spans per kind. Those, and long hexadecimal secrets, are the seed entities: the words in front of them are
lexical patterns. Identifier-like tokens (with digits) in the same contexts are the patterns' other instances. Spark scores the graph of
(pattern, instance) in rounds: a pattern's confidence is the smoothed mean score of its distinct instances, an instance's score the best
confidence of its patterns. Patterns of high confidence and support mark all their instances as spans of kind `id`.

DataFrame functions only. The graph is grouped to distinct pairs before each shuffle; its rows are checkpointed before the rounds.

A pattern that a third of all instances share is one key of the pair table; joins on it are split by Spark's skew handling, and counts are
summed before they are shuffled.

Defined results: null text counts as empty (no spans); null ids stay null, and ids may be of any type; rows join back by a SHA-256 of id and
text, and repeated rows get equal results, one each; very long texts are searched whole; other columns are not read; an empty table gives an
empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.tables import cut
from skein.llm.text import let, row_key

#: The contract's patterns. Loops that cannot match otherwise after giving back are possessive, and a run that failed at its
#: start is not tried again inside (\G: or just behind the last match), which keeps very long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: Tokens that may be identifiers, and those of them that are seeds.
CANDIDATE = r"(?<![A-Za-z0-9_-])[A-Za-z_-]*+[0-9][A-Za-z0-9_-]{5,}+"
SECRET = r"^[0-9a-f]{32,}$"
#: The pattern in front of an instance: up to two words, and what touches it.
CONTEXT = r"((?:[^\x20\x09-\x0D]+[\x20\x09]+){0,2}[^\x20\x09-\x0D]*)$"

SPAN = "array<struct<start:int,end:int,value:string,left:string>>"


@dataclass(frozen=True)
class Bootstrap:
    rounds: int = 3
    confidence: float = 0.8
    support: int = 3  # distinct instances
    reach: int = 60  # code points in front of an instance that its pattern may take
    smoothing: float = 0.5


def luhn(digits: Column) -> Column:
    def worth(i: Column) -> Column:  # i: 1 at the right end
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def spans(text: Column, pattern: str, reach: int = Bootstrap.reach) -> Column:
    """array<struct<start, end, value, left>> of the leftmost non-overlapping matches, in code points; left: up to `reach` in front.

    The pieces between matches and the matches themselves come from the same search, so lengths add up to places.
    """
    none = F.array().cast(SPAN)

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value"), F.right(x["piece"], F.lit(reach)).alias("left"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def placed(hits: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        pairs = F.arrays_zip(pieces.alias("piece"), hits.alias("hit"))
        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])

    return let(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda hits: F.when(F.size(hits) > 0, placed(hits)).otherwise(none))


def base_spans(text: Column, reach: int = Bootstrap.reach) -> dict[str, Column]:
    """By kind, what the contract's patterns find and its tests keep."""
    digits = lambda x: F.regexp_replace(x["value"], "[^0-9]", "")
    part = lambda p: F.ltrim(p, F.lit("0"))
    low = lambda x: F.forall(F.split(x["value"], r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.try_to_number(part(p), F.lit("999")), F.lit(0)) <= 255))
    found = lambda hint, pattern: F.when(hint, spans(text, pattern, reach)).otherwise(F.array().cast(SPAN))
    return {
        "email": found(text.contains("@"), EMAIL),
        "ip": F.filter(found(text.rlike(r"[0-9]\.[0-9]"), IP), low),
        "card": F.filter(found(text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), CARD), lambda x: F.when(F.length(digits(x)).between(16, 19), luhn(digits(x))).otherwise(False)),
        "phone": F.filter(found(text.contains("+"), PHONE), lambda x: F.length(digits(x)).between(8, 15)),
    }


def confident_patterns(edges: DataFrame, rules: Bootstrap = Bootstrap()) -> DataFrame:
    """(pattern, confidence) from distinct (pattern, value, seed) edges."""
    scored = edges.withColumn("s", F.col("seed").cast("double"))
    judge = lambda e: e.groupBy("pattern").agg((F.sum("s") / (F.count("*") + rules.smoothing)).alias("confidence"), F.count("*").alias("n"))
    for _ in range(rules.rounds):
        patterns = judge(scored).where(F.col("confidence") > 0)
        best = edges.join(patterns, "pattern").groupBy("value").agg(F.max("confidence").alias("best"))
        scored = cut(edges.join(best, "value", "left").withColumn("s", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("best", F.lit(0.0)))).drop("best"))
    return judge(scored).where((F.col("confidence") >= rules.confidence) & (F.col("n") >= rules.support)).select("pattern", "confidence")


def extract(docs: DataFrame, rules: Bootstrap = Bootstrap(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, key, an array of spans per base kind, and `id`, the spans that confident patterns add."""
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select("key", "doc_id", "t", *[c.alias(k) for k, c in base_spans(F.col("t"), rules.reach).items()])

    pattern = lambda x: F.lower(F.regexp_extract(x["left"], CONTEXT, 1))
    clear = lambda x: ~F.exists(F.concat(*KINDS), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    tagged = lambda c, seed: F.transform(c, lambda x: F.struct(pattern(x).alias("pattern"), x["value"].alias("value"), x["start"].alias("start"), x["end"].alias("end"), seed(x).alias("seed"), seed(x).isNull().alias("base")))
    others = F.when(F.col("t").rlike("[0-9]"), F.filter(spans(F.col("t"), CANDIDATE, rules.reach), clear)).otherwise(F.array().cast(SPAN))
    found = rows.where(F.col("t").rlike("[0-9@]")).select("key", F.explode(F.concat(tagged(F.concat(*KINDS), lambda x: F.lit(None).cast("boolean")), tagged(others, lambda x: x["value"].rlike(SECRET)))).alias("x"))
    found = cut(found.select("key", "x.*").withColumn("seed", F.coalesce("seed", F.lit(True))))

    edges = cut(found.groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    sure = confident_patterns(edges, rules)
    more = found.where(~F.col("base")).join(sure, "pattern", "left")
    more = more.where(F.col("confidence").isNotNull() | F.col("seed")).select("key", "start", "end").distinct()
    more = more.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("id"))
    return rows.drop("t").join(more, "key", "left").withColumn("id", F.coalesce("id", F.array().cast("array<struct<start:int,end:int>>")))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    out = extract(docs)
    named = lambda kind: F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))
    base = F.concat(*[named(k) for k in KINDS])
    return out.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, named("id")), ",").alias("spans"),
    )


def marks(kind: str) -> Column:
    """The spans of a kind as (start, end, what is put there)."""
    return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(f"<{kind}>").alias("name")))


def redact(docs: DataFrame, rules: Bootstrap = Bootstrap(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span of the text replaced by its kind in angle brackets; overlapping spans become one, named after the first.

    All columns stay as they are; rows without spans keep their text to the byte, and null texts stay null.
    """
    found = extract(docs, rules, id_col, text_col).select("key", F.array_sort(F.concat(*[marks(k) for k in (*KINDS, "id")])).alias("marks"))
    found = found.where(F.size("marks") > 0).dropDuplicates(["key"])

    def put(acc: Column, m: Column) -> Column:
        apart = F.concat(acc["out"], F.substr("t", acc["at"] + 1, m["start"] - acc["at"]), m["name"])
        return F.struct(F.greatest(acc["at"], m["end"]).alias("at"), F.when(m["start"] >= acc["at"], apart).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("marks", start, put, lambda acc: F.concat(acc["out"], F.substr("t", acc["at"] + 1)))
    # the input row travels as one column, so that its names meet none of these
    rows = docs.select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("t")).join(found, "key", "left")
    text = F.when(F.col("marks").isNotNull(), clean).otherwise(F.col("t"))
    return rows.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
