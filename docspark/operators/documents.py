"""Titles, captions, references, citations and cleaning that need joins or normal forms."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.text import CITATION, confidence, let
from docspark.operators.blocks import SEPARATOR, cells, flat
from docspark.operators.extraction import SECTIONS
from docspark.operators.verification import cited_ids

# Headings that are no titles, and phrases of templates.
SKIP = "abstract,introduction,references,contents,related work,related works,background,conclusion,conclusions,acknowledgements,acknowledgments,appendix,bibliography,methods,methodology,discussion".split(",")
TEMPLATES = [
    r"paper\s+title", r"use\s+style", r"enter\s+(?:the\s+)?title", r"your\s+title\s+here", r"insert\s+title", r"title\s+of\s+(?:the\s+)?(?:paper|manuscript|article)", r"manuscript\s+title", r"^untitled", r"sample\s+(?:paper|article|manuscript)", r"template",
]
# Parts of answers that only say that there is none, headings and first words of comparisons, and words that head the columns of a table.
ERRORS = ["i apologize, but i was unable", "this information is not available in the", "could not find relevant information", "unable to generate a verified response"]
COMPARISON_PARTS = ["research problem and motivation", "methodology and approach", "key findings and results", "datasets used", "limitations acknowledged"]
COMPARISON_INTRO = r"structured comparison of the (?:three|3) academic papers|paper comparison"
HEADER_TERMS = ["model", "method", "dimension", "dataset", "metric", "language", "generation", "speed", "efficiency", "modality", "paper"]


def normal_form(c: Column, form: str = "NFKC") -> Column:
    """The Unicode normal form; only rows with other than ASCII characters go through Python."""

    @F.pandas_udf("string")
    def normal(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return normal(c)


def clean_source(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds ``clean``: normal form, no invisible characters, hyphen breaks closed, plain quotes and dashes, single blanks."""
    t = F.regexp_replace(normal_form(F.col(column)), r"[\x{200b}-\x{200f}\x{feff}\x{ad}\x{2060}]", "")
    t = F.regexp_replace(t, r"(\w)-\s+(\p{Ll})", "$1$2")
    t = F.translate(t, "‘’“”–—", "''\"\"--")
    return df.withColumn("clean", F.trim(F.regexp_replace(t, r"\s+", " ")))


def valid_title(c: Column) -> Column:
    low = F.lower(F.trim(F.regexp_replace(c, r"^[\d.IVXivx]+\s+", "")))
    return F.length(c).between(5, 300) & ~low.isin(SKIP) & ~F.lower(c).isin(SKIP) & ~c.rlike(r"^[\d\.\s]+\z") & ~c.rlike("(?i)" + "|".join(f"(?:{p})" for p in TEMPLATES))


def extract_title(text: Column, meta: Column) -> Column:
    """Title of the file, else the first heading, else a bold line, else the first of ten lines that is valid and longer than 10 characters."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 10), lambda x: F.trim(x))
    valid = lambda a: F.try_element_at(F.filter(a, lambda x: valid_title(x)), F.lit(1))
    heading = valid(F.transform(F.filter(lines, lambda x: x.rlike(r"^#{1,2}\s+")), lambda x: F.trim(F.regexp_replace(x, r"^#+\s+|\*", ""))))
    bold = valid(F.transform(F.filter(lines, lambda x: x.rlike(r"^\*\*[^*]+\*\*$")), lambda x: F.regexp_replace(x, r"\*", "")))
    plain = F.try_element_at(F.filter(lines, lambda x: valid_title(x) & (F.length(x) > 10)), F.lit(1))
    ok = ~meta.startswith("D:") & (F.length(F.trim(meta)) > 3) & ~meta.rlike("(?i)" + "|".join(f"(?:{p})" for p in TEMPLATES))
    return F.coalesce(F.when(ok, F.trim(meta)), heading, bold, plain)


def figure_captions(docs: DataFrame) -> DataFrame:
    """doc_id, place, path, caption of every markdown image: a "Figure n" line among the first six lines after it (400 characters), else the last six before."""
    images = docs.select("doc_id", "text", F.posexplode(F.regexp_extract_all("text", F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), 1)).alias("place", "path"))
    at = F.call_function("locate", F.concat(F.lit("]("), F.col("path"), F.lit(")")), F.col("text"))
    end = at + F.length("path") + 3
    lines = lambda c: F.transform(F.split(c, "\n"), lambda x: F.trim(x))
    caption = lambda a: F.try_element_at(F.filter(a, lambda x: x.rlike(r"(?i)^\**(?:Figure|Fig\.?)\s*\d+\s*[:.]")), F.lit(1))
    after = F.slice(lines(F.substring(F.col("text"), end, F.lit(400))), 1, 6)
    start = F.greatest(F.lit(1), at - 400)
    before = F.reverse(F.slice(F.reverse(lines(F.substring(F.col("text"), start, at - start))), 1, 6))
    return images.select("doc_id", "place", "path", F.coalesce(caption(after), caption(before), F.lit("")).alias("caption"))


def captioned_figures(figures: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, page, figure_idx, number, caption, box of the caption: the first "Figure n" block from 10 above to 50 below a figure's lower edge, or 50 above to 10 below its upper one; else a made-up caption under it.

    The number is the first one in the caption.  Only blocks of a page that start like a caption meet its figures.
    """
    texts = blocks.where(F.col("text").rlike(r"(?i)^\s*(?:figure|fig\.?)\s*\d+")).select("doc_id", "page", "block_idx", F.trim("text").alias("caption"), F.struct("x0", "y0", "x1", "y1").alias("box"))
    near = F.col("box.y0").between(F.col("y1") - 10, F.col("y1") + 50) | F.col("box.y1").between(F.col("y0") - 50, F.col("y0") + 10)
    found = figures.join(texts, ["doc_id", "page"]).where(near).groupBy("doc_id", "page", "figure_idx").agg(F.min_by(F.struct("caption", "box"), "block_idx").alias("c"))
    joined = figures.join(found, ["doc_id", "page", "figure_idx"], "left")
    under = F.struct(F.col("x0"), (F.col("y1") + 5).alias("y0"), F.col("x1"), (F.col("y1") + 35).alias("y1"))
    caption = F.coalesce("c.caption", F.concat(F.lit("Figure on page "), F.col("page").cast("string")))
    number = F.coalesce(F.nullif(F.regexp_extract(caption, r"\d+", 0), F.lit("")).cast("long"), F.lit(1))
    return joined.select("doc_id", "page", "figure_idx", number.alias("number"), caption.alias("caption"), F.coalesce("c.box", under).alias("box"))


def figure_references(words: DataFrame, figures: DataFrame) -> DataFrame:
    """Adds ``places`` to ``captioned_figures``: word_idx, text and box of the words of its page that name the figure."""
    number = F.regexp_extract("text", r"^(?i)(?:fig\.|figure)\s*(\d+)\b", 1)
    named = words.withColumn("number", F.nullif(number, F.lit("")).cast("long")).where("number is not null")
    places = named.groupBy("doc_id", "page", "number").agg(F.array_sort(F.collect_list(F.struct("word_idx", "text", "x0", "y0", "x1", "y1"))).alias("places"))
    return figures.join(places, ["doc_id", "page", "number"], "left")


def box_sections(text: Column, raw: Column) -> Column:
    """Array of struct(order, title, content): what is between consecutive headings, given in order, if at least two are found; a heading is searched from the one before on, else from the start.

    Marks and numbers are cut from headings; persons' names and headings of one character are none; a section without content is left out.
    """
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    cleaned = lambda c: strip(F.regexp_replace(strip(F.regexp_replace(F.regexp_replace(strip(c), r"^#+\s*", ""), r"^\*+|\*+$", "")), r"^\d+(?:\.\d+)*[.)\s]+", ""))
    person = lambda t: t.rlike(r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,4}$") & ~F.lower(t).isin(SECTIONS) & ~t.rlike(r"^(?:[IVXLC]+|[A-Z])[\s.)]+")
    start = F.struct(F.array().cast("array<struct<at:int,title:string>>").alias("out"), F.lit(1).alias("from"))

    def step(acc: Column, title: Column) -> Column:
        here = F.call_function("locate", title, text, acc["from"])
        put = lambda at: F.struct(F.when(at > 0, F.array_append(acc["out"], F.struct(at.alias("at"), title.alias("title")))).otherwise(acc["out"]).alias("out"), F.when(at > 0, at).otherwise(acc["from"]).alias("from"))
        return let(F.when(here > 0, here).otherwise(F.call_function("locate", title, text)), put)

    def cut(found: Column) -> Column:
        def section(h: Column, k: Column) -> Column:
            begin = h["at"] + F.length(h["title"])
            end = F.coalesce(F.get(found, k + 1)["at"], F.length(text) + 1)
            return F.struct(k.alias("order"), h["title"].alias("title"), strip(F.substring(text, begin, F.greatest(F.lit(0), end - begin))).alias("content"))

        return F.when(F.size(found) >= 2, F.filter(F.transform(found, section), lambda s: s["content"] != ""))

    titles = F.filter(F.transform(raw, cleaned), lambda t: (F.length(t) >= 2) & ~person(t))
    return let(titles, lambda ts: let(F.array_sort(F.aggregate(ts, start, step, lambda acc: acc["out"])), cut))


def sections_of(docs: DataFrame) -> DataFrame:
    """doc_id, order, title, content of documents with doc_id, text and ``headings``, those of their layout boxes in order; all in the document's own row."""
    return docs.select("doc_id", F.explode(box_sections(F.col("text"), F.col("headings"))).alias("s")).select("doc_id", "s.order", "s.title", "s.content")


def sections_from_boxes(headings: DataFrame, docs: DataFrame) -> DataFrame:
    """As ``sections_of``, with the headings in a table of doc_id, ord and raw."""
    ordered = headings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "raw"))).alias("hs"))
    return sections_of(docs.select("doc_id", "text").join(ordered.select("doc_id", F.transform("hs", lambda h: h["raw"]).alias("headings")), "doc_id"))


def correct_citations(results: DataFrame, sources: DataFrame, *, scorer: Callable[[Column, Column], Column]) -> DataFrame:
    """Results whose claim cites a paragraph of the answer's sources get that paragraph's first source, with a score taken anew.

    The first citation of a claim counts.  Candidates are the sources of a paragraph with this full id, or with this short id, of any paper.  One candidate is taken as it is; of several the paragraph with the best
    ``scorer(claim, text)`` wins, if that is above -1, else the first.  A result that has the paragraph already stays, and so does one without candidates.  ``sources`` has answer_id, paragraph_id, ord, text and ``similarity``
    (to the answer's claims).  Only claims with a citation meet sources, those of their own answer.
    """
    ids = F.explode(F.array_distinct(F.array("paragraph_id", F.substring_index("paragraph_id", "_", -1))))
    keys = sources.select("answer_id", ids.alias("cited"), F.col("paragraph_id").alias("new_id"), F.struct("ord", "text", "similarity").alias("s"))
    cited = results.withColumn("cited", F.nullif(F.regexp_extract("claim", CITATION, 1), F.lit("")))
    pairs = cited.where("cited is not null").select("answer_id", "claim_idx", "claim", "cited").join(keys, ["answer_id", "cited"])
    each = pairs.groupBy("answer_id", "claim_idx", "new_id").agg(F.min("s").alias("s"), F.count("*").alias("n"), F.max(scorer(F.col("claim"), F.col("s.text"))).alias("raw"))
    best = F.max(F.when(F.col("raw") > -1, F.struct("raw", (-F.col("s.ord")).alias("first"), "new_id", "s")))
    chosen = each.groupBy("answer_id", "claim_idx").agg(F.sum("n").alias("n"), F.min(F.struct("s.ord", "new_id", "s")).alias("first"), best.alias("best"))
    winner = lambda c: F.when(F.col("n") > 1, F.col(f"best.{c}"))
    chosen = chosen.select("answer_id", "claim_idx", F.coalesce(winner("new_id"), F.col("first.new_id")).alias("new_id"), F.coalesce(winner("s"), F.col("first.s")).alias("s"))
    joined = results.join(chosen, ["answer_id", "claim_idx"], "left")
    moved = F.col("new_id").isNotNull() & (F.col("new_id") != F.coalesce("paragraph_id", F.lit("")))
    score = F.when(moved, F.col("s.similarity")).otherwise(F.col("score"))
    return joined.select("answer_id", "claim_idx", F.when(moved, F.col("new_id")).otherwise(F.col("paragraph_id")).alias("paragraph_id"), score.alias("score"), confidence(score).alias("confidence"), moved.alias("corrected"))


def validate_citations_stream(answers: DataFrame, valid: DataFrame) -> DataFrame:
    """answer_id, text: as the plain form, but a short id of any hit counts as valid; only unknown tags are taken out."""
    known = valid.select("answer_id", "paragraph_id").union(valid.select("answer_id", F.substring_index("paragraph_id", "_", -1))).distinct()
    each = answers.select("answer_id", F.explode(cited_ids(F.col("text"))).alias("paragraph_id")).join(known, ["answer_id", "paragraph_id"], "left_anti")
    gone = each.groupBy("answer_id").agg(F.collect_list(F.concat(F.lit("["), "paragraph_id", F.lit("]"))).alias("gone"))
    joined = answers.join(gone, "answer_id", "left")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.aggregate("gone", F.col("text"), lambda t, g: F.replace(t, g, F.lit(""))))
    return joined.select("answer_id", F.trim(F.regexp_replace(text, r"[ \t]{2,}", " ")).alias("text"))


def cited_assets(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """title, asset_id, ord: figures, tables and formulas cited by messages; the first candidate id that the paper has, each once."""
    candidates = F.array_distinct(F.array("paragraph_id", F.substring_index("paragraph_id", "_", -1), "ref", F.substring_index("ref", "_", -1)))
    each = items.select("title", "paper_id", "ord", F.posexplode(candidates).alias("rank", "asset_id"))
    there = each.join(chunks.where("chunk_type <> 'text'").select("paper_id", F.col("paragraph_id").alias("asset_id")).distinct(), ["paper_id", "asset_id"])
    chosen = there.groupBy("title", "paper_id", "ord").agg(F.min_by("asset_id", "rank").alias("asset_id"))
    return chosen.groupBy("title", "asset_id").agg(F.min("ord").alias("ord"))


def drop_low_value_messages(messages: DataFrame) -> DataFrame:
    """Without assistant messages that are errors, empty but for a disclaimer, or comparisons: by their first words, by a table of dimensions, papers and a synthesis, or by three of five headings with paper 1 and paper 2."""
    text = F.coalesce("text", F.lit(""))
    low = flat(F.lower(text))
    body = F.trim(F.regexp_replace(F.lower(text), r"(?s)\n\n---\n_?⚠️.*\z", ""))
    has = lambda c, values: F.exists(F.array(*[F.lit(v) for v in values]), lambda v: F.contains(c, v))
    error = (F.regexp_replace(body, r"\s", "") == "") | has(body, ERRORS)
    headers = lambda line: F.transform(cells(line), flat)
    compared = lambda h: (F.get(h, F.lit(0)) == "dimension") & F.array_contains(h, "synthesis") & F.exists(F.slice(h, 2, F.greatest(F.lit(0), F.size(h) - 1)), lambda c: c.startswith("paper 1"))
    lines = F.split(F.lower(text), "\n")
    nexts = F.slice(lines, 2, F.greatest(F.lit(0), F.size(lines) - 1))
    table = F.exists(F.zip_with(lines, nexts, lambda a, b: F.contains(a, F.lit("|")) & F.trim(b).rlike(SEPARATOR) & compared(headers(a))), lambda x: x)
    marks = F.size(F.filter(F.array(*[F.lit(m) for m in COMPARISON_PARTS]), lambda m: F.contains(low, m)))
    comparison = (F.trim(text) != "") & (low.rlike(COMPARISON_INTRO) | table | ((marks >= 3) & low.contains("paper 1") & low.contains("paper 2")))
    return messages.where(~((F.lower(F.coalesce("role", F.lit(""))) == "assistant") & (error | comparison)))


def needs_paragraph_fallback(spans: DataFrame, pages: DataFrame, least: float = 0.4) -> DataFrame:
    """span_id, fallback: no page holds the text, and none at least ``least`` of its words of 4 letters or more."""
    joined = spans.select("doc_id", "span_id", F.lower("text").alias("needle")).join(pages.select("doc_id", F.lower("text").alias("hay")), "doc_id")
    found = F.array_distinct(F.filter(F.split("needle", r"\s+"), lambda w: F.length(w) >= 4))
    share = F.when(F.size(found) > 0, F.size(F.filter(found, lambda w: F.contains(F.col("hay"), w))) / F.size(found)).otherwise(0.0)
    return joined.groupBy("span_id").agg((~F.bool_or(F.contains("hay", "needle")) & (F.max(share) < least)).alias("fallback"))


def locate_caption(captions: DataFrame, blocks: DataFrame) -> DataFrame:
    """caption_id, page, rule, x0, y0, x1, y1: where a caption stands: on its page, else the one before, the one after, the others in order.

    On a page: the first block with the whole caption (rule 0), its first 12 characters (1), "Table n" (2) or "Tab. n" (3), else the box round all blocks that hold keywords of 3 characters or more, if these occur at least twice (4).
    ``captions`` has doc_id, caption_id, page, caption, number, keywords; ``blocks`` doc_id, page, block, text and a box.
    """
    clean = lambda c: F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, r"[*|]", ""), r"\s+", " ")))
    keywords = F.filter(F.transform("keywords", lambda k: F.lower(F.trim(F.regexp_replace(k, r"[*|]", "")))), lambda k: F.length(k) >= 3)
    wanted = captions.select("doc_id", "caption_id", F.col("page").alias("want"), clean("caption").alias("c"), F.col("number").cast("string").alias("no"), keywords.alias("ks"))
    pairs = wanted.join(blocks.select("doc_id", "page", "block", F.lower("text").alias("t"), "x0", "y0", "x1", "y1"), "doc_id")
    numbered = lambda prefix: F.coalesce(F.contains("t", F.concat(F.lit(prefix), "no")), F.lit(False))
    whole = F.coalesce((F.col("c") != "") & F.contains("t", "c"), F.lit(False))
    begins = F.coalesce((F.length("c") > 12) & F.contains("t", F.substring("c", 1, 12)), F.lit(False))
    rule = F.when(whole, 0).when(begins, 1).when(numbered("table "), 2).when(numbered("tab. "), 3)
    times = lambda k: F.floor((F.length("t") - F.length(F.replace(F.col("t"), k, F.lit("")))) / F.length(k))
    hits = F.coalesce(F.aggregate("ks", F.lit(0).cast("long"), lambda a, k: a + times(k)), F.lit(0))
    found = pairs.withColumns({"rule": rule, "hits": hits}).where("rule is not null or hits > 0")
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    held = lambda f, c: f(F.when(F.col("hits") > 0, F.col(c))).alias(c)
    pages = found.groupBy("caption_id", "want", "page").agg(F.min(F.when(F.col("rule").isNotNull(), F.struct("rule", "block", *box))).alias("first"), F.sum("hits").alias("n"), held(F.min, "x0"), held(F.min, "y0"), held(F.max, "x1"), held(F.max, "y1"))
    away = F.col("page") - F.col("want")
    near = F.when(away == 0, 0).when(away == -1, 1).when(away == 1, 2).otherwise(3)
    either = F.when(F.col("first").isNotNull(), F.struct("first.rule", "first.x0", "first.y0", "first.x1", "first.y1")).when(F.col("n") >= 2, F.struct(F.lit(4).alias("rule"), *box))
    best = pages.withColumn("b", either).where("b is not null").groupBy("caption_id").agg(F.min_by(F.struct("page", "b"), F.struct(near, "page")).alias("m"))
    return best.select("caption_id", "m.page", "m.b.*")


def formula_chunk(title: Column, page: Column, kind: Column, number: Column, context: Column, content: Column) -> tuple[Column, Column]:
    """Display and enriched text of a formula; the enriched one has the prefix twice."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    prefix = F.concat_ws(" ", F.when(some(title), F.concat(F.lit("["), title, F.lit("]"))), F.concat(F.lit("[Equation on page "), page.cast("string"), F.lit(", type: "), kind, F.lit("]")), F.when(some(number), F.concat(F.lit("[Eq. "), number, F.lit("]"))))
    body = F.trim(F.regexp_replace(F.when(some(context), F.concat(context, F.lit("\n"), content)).otherwise(content), r"!\[[^\]]*\]\([^)]*\)", ""))
    display = F.concat(prefix, F.lit("\n"), body)
    return display, F.concat(prefix, F.lit("\n"), display)




# Publishers and programs that are no authors; commands of formulas and their words.
PUBLISHERS = "ieee,acm,springer,elsevier,wiley,nature,science,oxford university press,cambridge university press,taylor & francis,mdpi,frontiers,plos,arxiv,biorxiv,medrxiv,microsoft word,microsoft,latex,overleaf,apple,google,meta,openai".split(",")
MATH = [
    (r"\\(?:text|mathrm|operatorname)\{([^{}]*)\}", "$1"), (r"\$\$|\$|\\\(|\\\)|\\\[|\\\]", ""), (r"\\times", " x "), (r"\\cdot", " * "), (r"\\leq?", " <= "), (r"\\geq?", " >= "), (r"\\neq?", " != "), (r"\\approx", " ~ "), (r"\\infty", "infinity"),
    (r"\\(alpha|beta|gamma|delta|theta|lambda|sigma|sum|sqrt|mu)", "$1"), (r"[{}]", ""), (r"\s+", " "),
]


def extract_authors(text: Column, meta: Column, title: Column) -> Column:
    """Authors of the file unless it is a publisher or a template, else the first line of names after the title, up to the abstract."""
    ok = (F.length(F.trim(meta)) > 1) & ~F.lower(F.trim(meta)).isin(PUBLISHERS) & ~meta.rlike("(?i)template|author")
    lines = F.transform(F.split(F.split_part(text, title, F.lit(2)), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[*_0-9†‡]", "")))
    stop = F.array_position(F.transform(lines, lambda x: x.rlike(r"(?i)^(?:#|abstract|introduction|keyword)")), F.lit(True))
    head = F.slice(lines, 1, F.when(stop > 0, (stop - 1).cast("int")).otherwise(F.lit(20)))
    names = F.filter(head, lambda x: x.rlike(r"^\p{Lu}[\p{L}.'-]+(?: \p{Lu}[\p{L}.'-]*)+(?:(?:,| and|;) \p{Lu}[\p{L}.'-]+(?: \p{Lu}[\p{L}.'-]*)+)*\z"))
    return F.coalesce(F.when(ok, F.trim(meta)), F.regexp_replace(F.try_element_at(names, F.lit(1)), r",| and", ";"))


def plain_math(c: Column) -> Column:
    """A formula as plain words and signs."""
    for pattern, to in MATH:
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


def latin1(c: Column) -> Column:
    """Text that Latin-1 can hold: quotes and dashes plain, accents kept where it has them, other letters without accents, else ``?``; only rows with other than ASCII go through Python."""

    @F.pandas_udf("string")
    def folded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t: str | None) -> str | None:
            if t is None or t.isascii():
                return t
            return "".join(x if ord(x) < 256 else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode() or "?" for x in t)

        for batch in batches:
            yield batch.map(one)

    return folded(F.regexp_replace(F.translate(c, "‘’“”–—•", "''\"\"--*"), "…", "..."))


def pipe_rows(docs: DataFrame) -> DataFrame:
    """doc_id, row, header, cells of the pipe lines of a text, by the widest separator line; empty cells do not count.

    A line of more cells is cut into rows of that width, what is left over and lines of fewer cells are dropped.  The first row is the header if half of its cells, two at least, name something that heads tables and other rows
    follow; else the columns are "Model", "Column 2" and so on.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("line", F.trim("line")).where(F.contains("line", F.lit("|")))
    parts = F.filter(F.transform(F.split(F.regexp_replace("line", r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(F.regexp_replace(flat(x), r"<br>|\n", " "))), lambda x: x != "")
    typed = lines.select("doc_id", "n", parts.alias("cells"), F.col("line").rlike(SEPARATOR).alias("sep"))
    doc = Window.partitionBy("doc_id")
    width = F.coalesce(F.max(F.when(F.col("sep"), F.size("cells"))).over(doc), F.lit(0))
    kept = typed.withColumn("w", width).where(~F.col("sep") & (F.size("cells") > 0) & (F.size("cells") >= F.col("w")))
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.size("cells") / F.col("w")).cast("int") - 1), lambda i: F.slice("cells", i * F.col("w") + 1, F.col("w")))
    rows = kept.select("doc_id", "n", F.posexplode(F.when(F.col("w") > 0, cut).otherwise(F.array("cells"))).alias("part", "cells"))
    numbered = rows.withColumns({"row": F.row_number().over(doc.orderBy("n", "part")) - 1, "first": F.first("cells").over(doc.orderBy("n", "part")), "total": F.count("*").over(doc)})
    hits = F.size(F.filter("first", lambda c: F.exists(F.array(*[F.lit(t) for t in HEADER_TERMS]), lambda t: F.contains(F.lower(c), t))))
    headed = (F.col("total") > 1) & (hits >= F.greatest(F.lit(2), F.floor(F.size("first") / 2)))
    names = F.transform("first", lambda c, i: F.when(i == 0, "Model").otherwise(F.concat(F.lit("Column "), (i + 1).cast("string"))))
    out = numbered.withColumn("headed", headed).where(~F.col("headed") | (F.col("row") > 0))
    return out.select("doc_id", (F.col("row") - F.col("headed").cast("int")).alias("row"), F.when(F.col("headed"), F.col("first")).otherwise(names).alias("header"), "cells")


def formula_boxes(boxes: DataFrame, number_width: float = 30.0) -> DataFrame:
    """Boxes of formulas with the box of their number: the right ``number_width`` units."""
    right = F.struct((F.col("x1") - number_width).alias("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return boxes.where("kind = 'formula'").withColumn("number_box", right)


def chunks_by_papers(chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """Chunks of the wanted papers in the order of paper and paragraph; a paper without chunks appears once, empty."""
    joined = papers.select("paper_id").distinct().join(chunks, "paper_id", "left")
    return joined.withColumn("place", F.row_number().over(Window.partitionBy("paper_id").orderBy("paragraph_id")))
