"""License scans by diagonal voting, in DataFrame functions only.

Every text is cut into words; each rolling pair of words is hashed and joined to the places of that pair in the license
templates, where the words themselves are compared too.  A hit votes for the diagonal *text position - template position*.  Votes are counted by diagonal, and neighbouring diagonals of
one template, at most ``slack`` words apart, are merged (an inserted or lost word moves the rest of a template to the next diagonal): a running count over the diagonals in order numbers the merged spans, so
the work is in proportion to the hits.  Each span is verified:

* An exact template, and one of fewer than ``TOLERANT`` words, needs all its pairs on one diagonal.
* A longer one needs votes for its pairs, less two for each word that ``coverage`` lets miss, and then a chain of hits in which template and text positions both rise and no step leaves its diagonal by more than ``slack``.  The
  words of the best chain, over the greater of the template's words and the text's from the chain's start to its end, are its share; it must reach ``coverage`` as well.  So lost, added, swapped and
  changed words all lower it.  A merged span gives its best chain only.

The template table is a parameter of fixed size (some hundred pairs), so it is broadcast; the texts themselves
are never shuffled, only hits of some 40 bytes are, once.  A word pair that is very frequent meets the broadcast table in the task that read it,
so no key can pile up.  All hits of one text come to one task.  Null and empty texts have no words and no spans and still return a row; repeated rows return a row
each; an empty table gives an empty one; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import lower_ascii, split_words

#: What separates words.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

K = 2

#: Templates of fewer words must match whole: one changed word there is another license or version.
TOLERANT = 12


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False


#: The phrases whose places are counted, word by word.
BASE = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
)

#: Wordings that name a license, and sentences of license texts; matched with a tolerance for edits. Fixed values.
WORDINGS = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    Template("mit", "released under the mit license"),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    Template("lgpl", "under the terms of the gnu lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("zlib", "in no event will the authors be held liable for any damages arising from the use of this software"),
    Template("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    Template("epl-2.0", "made available under the terms of the eclipse public license 2 0"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("cc0-1.0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work"),
    Template("cc-by", "licensed under cc by 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
)


def words_of(text: Column) -> Column:
    return split_words(lower_ascii(text), NOT_WORD)


def template_pairs(spark, templates: tuple[Template, ...]) -> DataFrame:
    """A row per place of a word pair: pair hash, template number, place, the two words."""
    rows = [(n, t.text.split()) for n, t in enumerate(templates)]
    if short := [words for _, words in rows if len(words) < K]:
        raise ValueError(f"templates need {K} words or more: {short}")
    places = spark.createDataFrame(rows, "template int, words array<string>").select("*", F.explode(F.sequence(F.lit(0), F.size("words") - K)).alias("place"))
    places = places.select("template", "place", F.get("words", F.col("place")).alias("word"), F.get("words", F.col("place") + 1).alias("next_word"))
    return places.select(F.xxhash64("word", "next_word").alias("pair"), "*")


def scan_licenses(
    docs: DataFrame, *, templates: tuple[Template, ...] = BASE + WORDINGS, coverage: float = 0.8, slack: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Verified spans of every row: row, id_col, n_words, spans array<struct<first_word, template, label, exact, last_word, share>>.

    ``row`` is a number of the input row, so that rows that share an id stay apart.  Spans are sorted by first_word, then template.
    """
    spark = docs.sparkSession
    # One row more than pairs: it joins template -1, so that texts without a hit stay.
    anchor = spark.range(1).select(F.xxhash64(F.lit("")).alias("pair"), F.lit(-1).alias("template"), F.lit(0).alias("place"), F.lit("").alias("word"), F.lit("").alias("next_word"))
    pairs = template_pairs(spark, templates).union(anchor)
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    hashed = words.select("*", F.transform("words", lambda w, i: F.xxhash64(w, F.coalesce(F.get("words", i + 1), F.lit("")))).alias("pairs"))
    # The pair that starts at the last word has no second word and meets no template. The anchor stands at -1.
    placed = hashed.select("row", "id", "words", F.posexplode(F.concat(F.array(F.xxhash64(F.lit(""))), "pairs")).alias("at", "pair"))
    same = (F.get("words", F.col("at") - 1) == F.col("word")) & (F.get("words", F.col("at")) == F.col("next_word"))
    hits = placed.join(F.broadcast(pairs), "pair").where(F.when(F.col("template") < 0, F.col("at") == 0).otherwise(same))
    hits = hits.select("row", "id", F.size("words").alias("n_words"), "template", (F.col("at") - 1 - F.col("place")).alias("diagonal"), "place").repartition("row")

    of = lambda values, kind: F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("template"))
    whole = [t.exact or len(t.text.split()) < TOLERANT for t in templates]
    known = {"n": of([len(t.text.split()) for t in templates], "int"), "whole": of(whole, "boolean"), "label": of([t.label for t in templates], "string"), "exact": of([t.exact for t in templates], "boolean")}
    votes = hits.groupBy("row", "template", "diagonal").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.collect_set("place").alias("places")).withColumns(known)
    in_order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(in_order) > slack, F.lit(True))
    merged = votes.withColumn("opens", (F.col("whole") | apart).cast("int")).withColumn("span", F.sum("opens").over(in_order))
    merged = merged.withColumn("placed", F.transform("places", lambda p: F.struct((F.col("diagonal") + p).alias("at"), p.alias("place"))))
    spans = merged.groupBy("row", "template", "span").agg(
        *[F.first(c).alias(c) for c in ("id", "n_words", *known)], F.min("diagonal").alias("low"), F.array_sort(F.flatten(F.collect_list("placed"))).alias("hits")
    )
    votes_for = F.size(F.array_distinct(F.transform("hits", lambda h: h["place"])))
    end = F.col("low") + F.col("n") - 1
    in_one = F.when(votes_for == F.col("n") - K + 1, F.struct(F.col("low").alias("first_word"), end.alias("last_word"), F.lit(1.0).alias("share")))
    in_chain = F.when(votes_for >= (1 - K * (1 - coverage)) * (F.col("n") - K + 1), _chain(F.col("hits"), F.col("n"), slack))
    spans = spans.withColumn("found", F.when(F.col("template") < 0, None).when(F.col("whole"), in_one).otherwise(in_chain))
    span = F.struct("found.first_word", "template", "label", "exact", "found.last_word", "found.share")
    each = spans.groupBy("row").agg(F.first("id").alias(id_col), F.first("n_words").cast("long").alias("n_words"), F.array_sort(F.collect_list(F.when(F.col("found.share") >= coverage, span))).alias("spans"))
    return each.select("row", id_col, "n_words", "spans")


def _chain(hits: Column, n: Column, slack: int) -> Column:
    """first_word, last_word and share of the best chain of hits (at, place), which come in order; one state a template place is kept, so the work is hits times ``n``."""
    none = F.struct(F.lit(0).alias("words"), F.lit(0).alias("start"), F.lit(0).alias("at"))
    begin = F.struct(F.transform(F.sequence(F.lit(1), n), lambda _: none).alias("ends"), none.alias("best"))

    def step(state: Column, h: Column) -> Column:
        def onward(e: Column, q: Column) -> Column:
            follows = (e["words"] > 0) & (e["at"] < h["at"]) & (F.abs((h["at"] - h["place"]) - (e["at"] - q)) <= slack)
            more = F.when((q == h["place"] - 1) | (e["at"] == h["at"] - 1), 1).otherwise(2)  # a word that both pairs hold counts once
            return F.when(follows, F.struct((e["words"] + more).alias("words"), e["start"].alias("start")))

        before = F.array_max(F.transform(F.slice(state["ends"], F.lit(1), h["place"]), onward))
        new = F.struct(F.coalesce(before["words"], F.lit(K)).alias("words"), F.coalesce(before["start"], h["at"]).alias("start"), h["at"].alias("at"))
        replaces = lambda e: (new["words"] >= e["words"]) | (e["at"] + slack + 1 < h["at"])
        ends = F.transform(state["ends"], lambda e, q: F.when((q == h["place"]) & replaces(e), new).otherwise(e))
        return F.struct(ends.alias("ends"), F.when(new["words"] > state["best"]["words"], new).otherwise(state["best"]).alias("best"))

    def result(state: Column) -> Column:
        best = state["best"]
        last = best["at"] + K - 1
        return F.struct(best["start"].alias("first_word"), last.alias("last_word"), (best["words"] / F.greatest(n, last - best["start"] + 1)).alias("share"))

    return F.aggregate(hits, begin, step, result)
