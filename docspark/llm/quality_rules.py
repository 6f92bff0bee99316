"""Quality rules, line first: lines that fail a rule go, then documents that lost too much of their text.

Every line with a word is tried against the rules of ``rules()`` in their order, and the first one that it fails names it:

* boilerplate: a line of at most 20 words that holds one of the phrases ``BOILERPLATE``;
* navigation: a row of short entries between bars or bullets, or a line of at most four words that begins with a word of ``MENU`` and ends without a mark;
* punctuation: over half of its words hold symbols or repeated marks, or it has four words or more and no end of a sentence, neither at its end nor inside.

A document is kept if the failed lines hold at most ``max_lost`` of its characters in words and if it passes the base rules: 50 words at least, and at most half of its words in three-word
windows that occur twice or more in it.  The cleaned text is the lines that are left.

Words are runs of other characters than ASCII white space; lines end at a line feed.  Everything but the repeated windows is made of Spark's own functions; those are counted in Arrow batches, with word numbers of the text
instead of hashes, so the counts are exact and need some 60 bytes a word.  Rows do not meet: each is judged alone, repeated rows alike, and nothing is shuffled.  Null counts as a text
without words: it has no lines, fails the base rules and stays null.  An empty table gives an empty one.  Only the id and the text are read, whatever other columns there are.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import computed, split_words

LEAST_WORDS, MOST_REPEATED, MAX_LOST = 50, 0.5, 0.3

# Patterns that both Java's and DuckDB's regular expressions read alike.
SYMBOLS, BARS, WHITE = "#*$%&|<>", "|»›•", " \t\n\x0b\x0c\r"
#: From the first symbol or repeated mark of a word to its end, so each such word matches once.
MARKED_WORD = r"(?:[#*$%&|<>]|[!?]{2})[^\x20\x09-\x0D]*"
SENTENCE_END = r"[.!?:;…。！？][\x22\x27”’»)\]]*(?:[\x20\x09-\x0D]|\z)"
MENU = ("home", "menu", "contact", "about", "login", "log in", "sign in", "sign up", "search", "next", "previous", "back", "share", "print", "sitemap", "skip to", "read more", "archive", "tags")
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "we use cookies", "accept cookies", "enable javascript", "requires javascript",
    "click here", "subscribe to our", "follow us on", "powered by", "lorem ipsum", "tous droits réservés", "alle rechte vorbehalten", "todos los derechos reservados",
)
MENU_LINE = rf"^[\x20\x09-\x0D]*(?:{'|'.join(MENU)})(?:[\x20\x09-\x0D]|\z)"
RULES = ("boilerplate", "navigation", "punctuation")


def without(text: Column, characters: str) -> Column:
    """Length of the text without these characters."""
    return F.length(F.translate(text, characters, ""))


def rule(x: Column) -> Column:
    """The first rule that a measured line fails, in the order of trial, or null."""
    has_phrase = functools.reduce(Column.__or__, [F.contains(x["low"], F.lit(p)) for p in BOILERPLATE])
    navigation = ((x["bars"] >= 2) & (x["words"] <= 4 * (x["bars"] + 1))) | ((x["words"] <= 4) & x["low"].rlike(MENU_LINE) & ~x["ends"])
    punctuation = (2 * x["marked"] > x["words"]) | ((x["words"] >= 4) & ~x["ends"])
    return F.when(x["words"] == 0, None).when((x["words"] <= 20) & has_phrase, "boilerplate").when(navigation, "navigation").when(punctuation, "punctuation")


def judged_lines(text: Column) -> Column:
    """Of each line: line, words, chars, rule (that it fails, or null)."""
    # One step after the other, so that each measure is taken once a line.
    counted = F.transform(F.split(text, "\n", -1), lambda line: F.struct(line.alias("line"), F.size(split_words(line)).alias("words")))
    measured = F.transform(counted, lambda x: F.struct(
        x["line"].alias("line"), x["words"].alias("words"), without(x["line"], WHITE).alias("chars"), (F.length(x["line"]) - without(x["line"], BARS)).alias("bars"),
        F.regexp_count(x["line"], F.lit(MARKED_WORD)).alias("marked"), x["line"].rlike(SENTENCE_END).alias("ends"), F.when(x["words"] <= 20, F.lower(x["line"])).otherwise("").alias("low"),
    ))
    return F.transform(measured, lambda x: F.struct(x["line"].alias("line"), x["words"].alias("words"), x["chars"].alias("chars"), rule(x).alias("rule")))


def repeated_words(text: bytes | None, width: int = 3) -> int:
    """Words that stand in a window of ``width`` words which occurs at least twice in the text."""
    words = (text or b"").split()  # at ASCII white space
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    windows = ids
    for k in range(1, width):  # numbers of ever wider windows, always below the length of the text
        windows = np.unique(windows[: len(windows) - 1] * len(number) + ids[k:], return_inverse=True)[1]
    repeated = np.bincount(windows)[windows] > 1
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : k + n] |= repeated
    return int(covered.sum())


def clean_documents(
    docs: DataFrame, *, max_lost: float = MAX_LOST, least_words: int = LEAST_WORDS, most_repeated: float = MOST_REPEATED, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True
) -> DataFrame:
    """The id, the counts of the base rules, base_failed, kept, n_lines, the lines that each rule removed, lost (share of the characters), and ``cleaned``, the text that is left."""
    lines = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), judged_lines(F.col(text_col)).alias("_lines"))
    text = F.coalesce(F.col("_text"), F.lit(""))
    total = lambda c: F.coalesce(F.aggregate("_lines", F.lit(0).cast("long"), lambda s, x: s + x[c]), F.lit(0))
    with_word = F.transform(F.filter("_lines", lambda x: x["words"] > 0), lambda x: x["line"])
    counted = lines.select(
        "_id", "_lines", F.col("_text").cast("binary").alias("_bytes"),
        total("words").alias("n_words"), total("chars").alias("word_chars"), (F.length(text) - without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        F.coalesce(F.size(with_word) - F.size(F.array_distinct(with_word)), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate("_lines", F.lit(0).cast("long"), lambda s, x: s + F.when(x["rule"].isNotNull(), x["chars"]).otherwise(0)), F.lit(0)).alias("_lost"),
    )

    def removed_by(rule: str) -> Column:
        return F.when(F.col("_lines").isNull(), 0).otherwise(F.size(F.filter("_lines", lambda x: x["rule"] == rule))).cast("long").alias(f"{rule}_lines")

    removed = [removed_by(r) for r in RULES]
    cleaned = F.array_join(F.transform(F.filter("_lines", lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n").alias("cleaned")
    counted = counted.select(
        "_id", "_bytes", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"), *removed,
        F.when(F.col("word_chars") > 0, F.col("_lost") / F.col("word_chars")).otherwise(0.0).alias("lost"), *([cleaned] if with_text else []),
    )
    found = computed(counted, ["_bytes"], "n_repeat_words bigint", lambda: lambda text: (repeated_words(text),))
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return found.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("lost") <= max_lost)).alias("kept"),
        "n_lines", *[f"{r}_lines" for r in RULES], "lost", *(["cleaned"] if with_text else []),
    )
