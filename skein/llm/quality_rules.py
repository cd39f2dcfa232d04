"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text goes with them.

DataFrame functions only; one pass over the table, no shuffle, so a hot source or a group of copies cannot skew it.

Defined results: a null text counts as empty (0 words, rejected); a null id stays null; repeated rows each get their own,
equal result; a very long text is judged whole, line by line; other columns of the input are not read, so clashing names are harmless; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.text import computed_once, let, words

#: Symbols that prose rarely has, endings of sentences, and phrases of page furniture (lower case).
SYMBOLS = r"[#*$%&|<>]"
SENTENCE_END = r"[.!?:;\x{2026}\x{3002}\x{FF01}\x{FF1F}][\x22\x27\x{2019}\x{201D}\x{BB})\]]*[\x20\x09\x0D]*$"
BOILERPLATE = (
    # English
    "all rights reserved", "click here", "cookie policy", "enable javascript", "log in to", "privacy policy", "share this", "sign up for", "skip to content", "subscribe to", "terms of use",
    # German
    "alle rechte vorbehalten", "cookie-richtlinie", "datenschutzerklärung", "hier klicken", "javascript aktivieren", "jetzt anmelden", "newsletter abonnieren", "nutzungsbedingungen", "zum inhalt springen",
    # French
    "aller au contenu", "cliquez ici", "conditions générales", "inscrivez-vous", "mentions légales", "politique de confidentialité", "politique des cookies", "tous droits réservés",
    # Spanish
    "aviso legal", "haga clic", "haz clic", "ir al contenido", "política de cookies", "política de privacidad", "suscríbete", "términos de uso", "todos los derechos reservados",
)
#: One of them at the start of a line or behind a space.
FURNITURE = r"(?:^|\x20)(?:" + "|".join(BOILERPLATE) + ")"


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_pct: int = 20  # words in repeated windows, of all words
    window: int = 5
    max_line_symbols: float = 0.04  # of a line's characters
    min_nav_bars: int = 3  # " | " or " > " between entries of a menu
    max_shouts: int = 3  # "!!" or "??" in one line
    min_open_words: int = 12  # words of a line that may lack a sentence's end, as in cut-off prose
    max_stutters: int = 3  # words that follow themselves
    max_lost: float = 0.5  # of the characters in lines that have a word


def repeated_window_words(w: Column, size: int) -> Column:
    """Words that stand in windows of `size` words found twice or more; w is an array<string> column.

    Windows become 64-bit hashes; only where some hash repeats are they sorted with their places, and the union of the repeated
    windows is measured by steps between neighbouring places.
    """

    def union(places: Column) -> Column:
        start = F.struct(F.lit(-size).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(size), p - acc["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    def measured(h: Column) -> Column:
        placed = F.sort_array(F.arrays_zip(h.alias("h"), F.sequence(F.lit(0), F.size(h) - 1).alias("at")))
        twice = lambda s: F.filter(
            s,
            lambda x, i: ((i > 0) & (F.try_element_at(s, i)["h"] == x["h"])) | F.coalesce(F.try_element_at(s, i + 2)["h"] == x["h"], F.lit(False)),
        )
        return let(placed, lambda s: union(F.sort_array(F.transform(twice(s), lambda x: x["at"]))))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[w[i + k] for k in range(size)]))
    judged = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), measured(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(w) >= size, judged).otherwise(F.lit(0).cast("long"))


def line_fails(line: Column, rules: Rules) -> Column:
    """A line with a word fails as symbol junk, shouting, stutter, a menu, boilerplate, or for want of a sentence's end."""
    count = lambda pattern: F.regexp_count(line, F.lit(pattern))
    symbols = F.length(line) - F.length(F.regexp_replace(line, SYMBOLS + "+", ""))
    return (
        (symbols > F.length(line) * rules.max_line_symbols)
        | (count(r" [|>\x{BB}\x{2022}] ") >= rules.min_nav_bars)
        | (count(r"!!|\?\?") >= rules.max_shouts)
        | (count(r"(?<![^\x20])([^\x20]++)\x20\1(?![^\x20])") >= rules.max_stutters)
        | F.lower(line).rlike(FURNITURE)
        | (~line.rlike(SENTENCE_END) & ~line.rlike(r"(?:[^\x20]++\x20++){" + str(rules.min_open_words) + "}"))
    )


def line_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules(), carry: bool = False) -> DataFrame:
    """One row per input row: id, counts, base_failed, lost (share of text), kept and clean_text (lines that passed, in order).

    A repeated line counts as lost from its second occurrence on. carry: also `row`, the input row as a struct.
    """
    text = F.coalesce(F.col("t"), F.lit(""))
    own = ["doc_id", "row"] if carry else ["doc_id"]
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), *[F.struct(*docs.columns).alias("row")] * carry)
    out = out.select(*own, text.alias("t"), words(text).alias("w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    out = out.select(*own, "t", "w", "lines", F.array_distinct("lines").alias("own"))
    out = out.withColumn("passed", F.filter("own", lambda x: ~line_fails(x, rules)))
    chars = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    out = out.select(
        *own,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS + "+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size("own")).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("w"), rules.window).alias("n_repeat_words"),
        chars("lines").alias("all_chars"),
        chars("passed").alias("passed_chars"),
        F.array_join("passed", "\n").alias("clean_text"),
    )
    base_failed = (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_pct)
    lost = F.when(F.col("all_chars") > 0, 1 - F.col("passed_chars") / F.col("all_chars")).otherwise(F.lit(1.0))
    out = out.withColumn("base_failed", base_failed).withColumn("lost", lost)
    return computed_once(out.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= rules.max_lost)).drop("all_chars", "passed_chars"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """docs without the rejected rows, and without the failing lines of the others."""
    out = line_first(docs, id_col, text_col, rules, carry=True).where("kept")
    return out.select(*[F.col("clean_text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return line_first(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
