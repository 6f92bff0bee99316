"""Layout of pages: the order in which boxes are read, titles and authors from it, and words with their boxes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.text import let
from docspark.operators.documents import extract_authors, extract_title, valid_title

BOX = ("x0", "y0", "x1", "y1")


def plain_words(text: Column) -> Column:
    """Lower-case words without the marks of bold text and tables."""
    return F.array_remove(F.split(F.lower(F.regexp_replace(text, r"[*|]", " ")), r"\s+"), "")


def phrase_start(needle: Column, page: Column) -> Column:
    """The first place (from 0) on a page where the words of a needle stand one after the other, else null; the last one only has to begin there.

    ``page`` is the page's words, each behind a line feed, which no word has.
    """
    at = F.instr(page, F.concat(F.lit("\n"), F.array_join(needle, "\n")))
    before = F.substring(page, F.lit(1), at)
    return F.when((F.size(needle) > 0) & (at > 0), F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) - 1)


def pages_of_words(words: DataFrame) -> DataFrame:
    """doc_id, page, words: the words (text and box) of every page in their order."""
    row = F.struct("word_idx", "text", *BOX)
    held = words.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(row)).alias("words"))
    return held.withColumn("words", F.transform("words", lambda w: F.struct(w["text"].alias("text"), *[w[c].alias(c) for c in BOX])))


def locate_caption_words(captions: DataFrame, words: DataFrame) -> DataFrame:
    """``locate_captions`` on words as rows: ``words`` has doc_id, page, word_idx (from 0, without gaps), text and a box."""
    return locate_captions(captions, pages_of_words(words))


def locate_captions(captions: DataFrame, pages: DataFrame) -> DataFrame:
    """caption_id, page, rule, x0, y0, x1, y1: the box round the words of a caption: on its page, else the one before, the one after, the others in order.

    On a page: the whole caption (rule 0), its first 12 characters if it is longer (1), "Table n" (2), "Tab. n" (3), else all words that hold one of the keywords of three characters or more, if there are at least two (4).
    ``captions`` has caption_id (unique), doc_id, page, caption, number and keywords; ``pages`` has doc_id, page and words, an array of text and box.  A page is one row and moves once, to the captions of its document; nothing is
    made of pairs of words.
    """
    # A word of several marks or none after cleaning keeps its number and matches nothing.
    clean = F.transform("words", lambda w: F.struct(F.coalesce(F.array_join(plain_words(w["text"]), ""), F.lit("")).alias("w"), *[w[c].alias(c) for c in BOX]))
    number = F.col("number").cast("string")
    whole = F.array_join(plain_words(F.col("caption")), " ")
    kinds = [
        plain_words(F.col("caption")), F.when(F.length(whole) > 12, plain_words(F.substring(whole, 1, 12))), F.when(number.isNotNull(), F.array(F.lit("table"), number)), F.when(number.isNotNull(), F.array(F.lit("tab."), number)),
    ]
    keys = F.filter(F.transform("keywords", lambda k: F.lower(F.trim(F.regexp_replace(k, r"[*|]", "")))), lambda k: F.length(k) >= 3)
    asked = captions.select("caption_id", "doc_id", F.col("page").alias("want"), F.array(*kinds).alias("needles"), keys.alias("keys"))
    pairs = asked.join(pages.select("doc_id", "page", clean.alias("words")), "doc_id")
    phrase = lambda rule: F.get("needles", F.lit(rule))
    at = lambda flat, rule: let(phrase_start(phrase(rule), flat), lambda s: F.when(s.isNotNull(), F.struct(F.lit(rule).alias("rule"), F.slice("words", s + 1, F.size(phrase(rule))).alias("held"))))
    keyed = let(F.filter("words", lambda w: F.exists("keys", lambda k: F.contains(w["w"], k))), lambda held: F.when(F.size(held) >= 2, F.struct(F.lit(len(kinds)).alias("rule"), held.alias("held"))))
    flat = F.concat(F.lit("\n"), F.array_join(F.transform("words", lambda w: w["w"]), "\n"))
    # One or no element, so that the place is found once and not again for a filter.
    first = let(flat, lambda flat: F.coalesce(*[at(flat, rule) for rule in range(len(kinds))], keyed))
    chosen = pairs.select("caption_id", "want", "page", F.explode(F.array_compact(F.array(first))).alias("f")).select("caption_id", "want", "page", "f.*")
    edge = lambda f, c: f(F.transform("held", lambda w: w[c])).alias(c)
    found = chosen.select("caption_id", "want", "page", "rule", edge(F.array_min, "x0"), edge(F.array_min, "y0"), edge(F.array_max, "x1"), edge(F.array_max, "y1"))
    away = F.col("page") - F.col("want")
    near = F.when(away == 0, 0).when(away == -1, 1).when(away == 1, 2).otherwise(3)
    best = found.groupBy("caption_id").agg(F.min_by(F.struct("page", "rule", *BOX), F.struct(near, "page")).alias("b"))
    return best.select("caption_id", "b.*")


def cut_order(boxes: list[tuple[float, float, float, float]], gap: float = 1.0) -> list[int]:
    """Reading order of boxes (x0, y0, x1, y1) by recursive cuts: at the gaps between rows, from the top down, else at those between columns, from left to right, and what cannot be cut by top and left edge."""

    def pieces(of: list[int], low: int, high: int) -> list[list[int]]:
        out, end = [], None
        for i in sorted(of, key=lambda i: (boxes[i][low], i)):
            if end is None or boxes[i][low] >= end + gap:
                out.append([])
                end = boxes[i][high]
            out[-1].append(i)
            end = max(end, boxes[i][high])
        return out

    order, todo = [], [list(range(len(boxes)))]
    while todo:
        of = todo.pop()
        for low, high in ((1, 3), (0, 2)):
            if len(of) > 1 and len(parts := pieces(of, low, high)) > 1:
                todo += reversed(parts)
                break
        else:
            order += sorted(of, key=lambda i: (boxes[i][1], boxes[i][0], i))
    return order


def reading_order(boxes: DataFrame, *, gap: float = 1.0) -> DataFrame:
    """``boxes`` (doc_id, page, box_idx, a box and more) with ``ord``, the place on the page, from 0; a page is worked on by itself, and boxes of equal edges follow each other by box_idx."""
    box = F.struct("box_idx", *BOX)
    pages = boxes.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(box)).alias("b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, page, found in zip(batch["doc_id"], batch["page"], batch["b"], strict=True):
                order = cut_order([tuple(float(b[c]) for c in BOX) for b in found], gap)
                out += [(doc, page, found[i]["box_idx"], n) for n, i in enumerate(order)]
            yield pd.DataFrame(out, columns=["doc_id", "page", "box_idx", "ord"])

    kinds = ", ".join(f"{c} {boxes.schema[c].dataType.simpleString()}" for c in ("doc_id", "page", "box_idx"))
    return boxes.join(pages.mapInPandas(run, f"{kinds}, ord int"), ["doc_id", "page", "box_idx"])


def _bare(c: Column) -> Column:
    """Without the marks of headings and bold text at either end."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"^#+\s*|^\*+|\*+$", ""))


def _box_texts(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    joined = boxes.join(pages.select("doc_id", "page", F.col("text").alias("page_text")), ["doc_id", "page"])
    return joined.withColumn("raw", F.substring("page_text", F.col("pos_start") + 1, F.col("pos_end") - F.col("pos_start")))


def titles_from_boxes(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, title, tier: the first valid title box of the first two pages (1), the first valid section header of the first page (2), or its first box, if that is text at its start and longer than 10 characters (3).

    ``boxes`` has doc_id, page (from 1), ord, kind, pos_start and pos_end, ``pages`` doc_id, page and text.
    """
    read = _box_texts(boxes.where("page <= 2"), pages).withColumn("title", _bare(F.col("raw"))).where(valid_title(F.col("title")))
    first = F.col("page") == 1
    long_text = first & (F.col("ord") == 0) & (F.col("kind") == "text") & (F.col("pos_start") == 0) & (F.length("title") > 10)
    tier = F.when(F.col("kind") == "title", 1).when(first & (F.col("kind") == "section-header"), 2).when(long_text, 3)
    return read.withColumn("tier", tier).where("tier is not null").groupBy("doc_id").agg(F.min_by(F.struct("title", "tier"), F.struct("tier", "page", "ord")).alias("t")).select("doc_id", "t.title", "t.tier")


# The form of a name, signs that stand at names, and words of affiliations.
NAME = r"(?:^|\s)([A-Z][a-z]+(?:\s+[A-Z]\.?)?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]{1,7})?)"
NAME_SIGNS, EMAIL = r"[\d†‡§¶∗◦·•]", r"[\w.+-]+@[\w-]+\.[\w.]+"
AFFILIATION = r"(?i)university|institute|department|school|college|lab|center|centre|faculty|hospital|inc\.|corp\.|ltd\.|@|\.edu|\.ac\.|\.org"


def names_in(raw: Column) -> Column:
    """Names of a box: those in bold, else, unless it names an affiliation, one of each piece between commas, semicolons and "and"."""
    without = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, NAME_SIGNS, ""), EMAIL, ""))
    name = lambda c: F.trim(F.regexp_extract(c, NAME, 1))
    some = lambda a: F.filter(a, lambda x: x != "")
    bold = some(F.transform(F.filter(F.transform(F.regexp_extract_all(raw, F.lit(r"\*\*(.+?)\*\*"), 1), without), lambda x: F.length(x).between(4, 99)), name))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(raw, r"^\s*#+\s*", "")), r"[_*]", ""), EMAIL, ""), r"\[.*?\]", ""), NAME_SIGNS, "")

    def pieces(text: Column) -> Column:
        each = F.transform(F.split(text, r"[,;]|\band\b"), lambda x: F.trim(F.regexp_replace(x, r"\s{2,}", " ")))
        found = F.filter(F.transform(F.filter(each, lambda x: F.length(x) >= 3), name), lambda x: F.length(x).between(4, 79))
        return F.when(F.length(text).between(3, 500) & ~text.rlike(AFFILIATION), found).otherwise(F.array().cast("array<string>"))

    return let(bold, lambda b: F.when(F.size(b) > 0, b).otherwise(let(plain, pieces)))


def authors_from_boxes(boxes: DataFrame, pages: DataFrame, titles: DataFrame) -> DataFrame:
    """doc_id, authors: the names on the first page between the title and the abstract, each once, joined by semicolons; ``titles`` has doc_id and title. No row without a title box or without names."""
    read = _box_texts(boxes.where("page = 1"), pages).join(titles, "doc_id").withColumn("head", F.substring(F.lower("title"), 1, 40))
    cleaned = F.lower(_bare(F.col("raw")))
    is_title = (F.col("head") != "") & F.startswith(cleaned, F.col("head"))
    of_page = Window.partitionBy("doc_id")
    marked = read.withColumns({"is_title": is_title, "abstract": ~is_title & cleaned.rlike(r"\babstract\b")})
    end = F.min(F.when(F.col("abstract"), F.struct("ord", "pos_start"))).over(of_page)
    bounded = marked.withColumn("stop", end)
    upto = F.col("stop").isNull() | (F.col("ord") < F.col("stop.ord"))
    bounded = bounded.withColumns({"title_end": F.coalesce(F.max(F.when(F.col("is_title") & upto, F.col("pos_end"))).over(of_page), F.lit(0)), "last": F.coalesce("stop.pos_start", F.length("page_text"))})
    between = bounded.where((F.col("title_end") > 0) & (F.col("pos_start") >= F.col("title_end")) & (F.col("pos_start") < F.col("last")))
    found = between.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", names_in(F.col("raw")).alias("names")))).alias("n"))
    joined = F.array_join(F.array_distinct(F.flatten(F.transform("n", lambda x: x["names"]))), "; ")
    return found.select("doc_id", joined.alias("authors")).where("authors <> ''")


def titles_and_authors(docs: DataFrame, boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, title, authors, title_tier: from the file's own fields, else from the layout, else from the text; ``docs`` has doc_id, text, meta_title and meta_author.

    ``title_tier`` is 0 for the file's fields, 1 to 3 as in ``titles_from_boxes``, 4 for the text, null without a title.
    """
    nothing = F.lit("")
    of_meta = lambda c: F.coalesce(c, nothing)
    own = extract_title(nothing, of_meta(F.col("meta_title")))
    titled = docs.join(titles_from_boxes(boxes, pages).withColumnRenamed("title", "box_title"), "doc_id", "left").withColumns({"own": own, "of_text": extract_title(F.coalesce("text", nothing), nothing)})
    title = F.coalesce("own", "box_title", "of_text")
    step = F.when(F.col("own").isNotNull(), 0).when(F.col("box_title").isNotNull(), F.col("tier")).when(F.col("of_text").isNotNull(), 4)
    titled = titled.withColumns({"title": title, "title_tier": step})
    by_layout = authors_from_boxes(boxes, pages, titled.where("title is not null").select("doc_id", "title"))
    joined = titled.join(by_layout.withColumnRenamed("authors", "box_authors"), "doc_id", "left")
    meta_author = extract_authors(nothing, of_meta(F.col("meta_author")), nothing)
    text_author = extract_authors(F.coalesce("text", nothing), nothing, F.coalesce("title", nothing))
    return joined.select("doc_id", "title", F.coalesce(meta_author, "box_authors", text_author).alias("authors"), "title_tier")
