"""Markdown blocks of answers and what is read off them; line by line, then gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.text import let
from docspark.operators.answers import split_parts

# What is removed or rewritten before blocks are read, in this order.
CLEAN = [
    (r"\r\n?", "\n"), (r"(?s)\n\n---\n_?⚠️.*\z", ""), (r"!\[[^\]]*\]\([^)]+\)", ""), (r"```[a-zA-Z0-9_-]*\n?|```", ""), (r"`([^`]+)`", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"(?m)^>\s?", ""), (r"(?m)^[-*_]{3,}\s*$", ""),
    (r"\[[a-f0-9]{8}_[PTFE]\d+\]", ""),
]
CITATION_START = r"^\[(?:[a-f0-9]{1,8}_)?[PTFE]\d+(?:-S\d+)?\]"
CITATION_ANY = r"\[(?:[a-f0-9]{8}_)?[PFTEpfte]\d+\]"
SEPARATOR = r"^\|?[\s:]*-{2,}[\s:]*(?:\|[\s:]*-{2,}[\s:]*)+\|?\s*$"


def clean_source(c: Column) -> Column:
    for pattern, to in CLEAN:
        c = F.regexp_replace(c, pattern, to)
    return c


def flat(c: Column) -> Column:
    """Without bold and italic marks."""
    return F.trim(F.regexp_replace(c, r"\*{1,2}([^*\n]+)\*{1,2}", "$1"))


def cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))


def blocks_of(text: Column) -> Column:
    """The blocks of a text, array<struct<kind, level, text, rows>>; null for null.

    A line that starts with a citation belongs to the one before.  A run of pipe lines is a table if it has a separator; paragraphs are runs of other lines, a hyphen at a line's end is closed up.
    Everything about a text happens in its own row: places at which something starts are kept, and what lies between two of them is cut out.
    """
    places = lambda xs: F.transform(xs, lambda _, i: i)
    pieces = lambda xs, starts, of: F.transform(starts, lambda at, k: of(at, F.slice(xs, at + 1, F.coalesce(F.get(starts, k + 1), F.size(xs)) - at)))

    def piped(line: Column) -> Column:
        tabs = F.length(F.regexp_replace(line, r"[^\t]", ""))
        return F.when((tabs >= 2) & ~F.contains(line, F.lit("|")), F.concat(F.lit("|"), F.replace(line, F.lit("\t"), F.lit("|")), F.lit("|"))).otherwise(line)

    def joined(lines: Column) -> Column:
        own = F.filter(places(lines), lambda i: ~((i > 0) & F.get(lines, i).rlike(CITATION_START) & (F.get(lines, i - 1) != "")))
        return let(own, lambda starts: pieces(lines, starts, lambda _, ls: let(F.array_join(ls, " "), typed)))

    def typed(line: Column) -> Column:
        kind = F.when(line == "", "blank").when(line.rlike(r"^#{1,6}\s"), "heading").when(line.rlike(r"^(?:[-*+]|\d+\.)\s+"), "bullet").when(line.startswith("|") | line.rlike(SEPARATOR), "table").otherwise("paragraph")
        return F.struct(kind.alias("kind"), line.alias("line"))

    def runs(typed_lines: Column) -> Column:
        kind = lambda i: F.get(typed_lines, i)["kind"]
        first = F.filter(places(typed_lines), lambda i: (i == 0) | kind(i).isin("heading", "bullet") | (kind(i) != kind(i - 1)))
        run = lambda at, ls: F.struct(kind(at).alias("kind"), F.transform(ls, lambda x: x["line"]).alias("lines"))
        return F.filter(let(first, lambda starts: pieces(typed_lines, starts, run)), lambda r: r["kind"] != "blank")

    def block(run: Column) -> Column:
        kind, lines, first = run["kind"], run["lines"], F.get(run["lines"], F.lit(0))
        table = (kind == "table") & F.exists(lines, lambda x: x.rlike(SEPARATOR)) & (F.size(lines) >= 2)
        rows = F.transform(F.filter(lines, lambda x: ~x.rlike(SEPARATOR)), lambda x: F.transform(cells(x), lambda c: flat(c)))
        text = F.when(kind == "heading", F.regexp_replace(first, r"^#{1,6}\s+", "")).when(kind == "bullet", F.regexp_replace(first, r"^(?:[-*+]|\d+\.)\s+", "")).otherwise(F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"-\n(?=\p{Ll})", ""), r"\n", " "))
        level = F.when(kind == "heading", F.length(F.regexp_extract(first, r"^(#{1,6})", 1))).otherwise(0)
        made = lambda is_table: F.struct(F.when(is_table, "table").when(kind == "table", "paragraph").otherwise(kind).alias("kind"), level.alias("level"), F.when(is_table, "").otherwise(flat(text)).alias("text"), F.when(is_table, rows).alias("rows"))
        return let(table, made)

    lines = F.transform(F.split(clean_source(text), "\n"), lambda x: let(F.trim(x), piped))
    return F.transform(let(let(lines, joined), runs), block)


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, block, kind (heading, bullet, table, paragraph), level, text, rows array<array<string>> (headers first) of every document, as ``blocks_of`` reads them; rows of ``docs`` never meet."""
    return docs.select("doc_id", F.posexplode(blocks_of(F.col("text"))).alias("block", "b")).select("doc_id", "b.*", "block")


def labelled_rows(rows: Column | None = None) -> Column:
    """Rows of a table block as ``header: cell`` pairs; a cell beyond the headers is labelled by its column's number."""
    rows = F.col("rows") if rows is None else rows
    header = F.get(rows, F.lit(0))
    label = lambda i: F.coalesce(F.get(header, i), F.concat(F.lit("Column "), (i + 1).cast("string")))
    pairs = lambda row: F.array_join(F.transform(row, lambda c, i: F.concat(label(i), F.lit(": "), c)), " | ")
    return F.transform(F.slice(rows, 2, F.greatest(F.lit(0), F.size(rows) - 1)), pairs)


def text_of(blocks: Column, style: str = "plain") -> Column:
    """Blocks in their order joined by blank lines, empty ones left out, bullets with a dash.

    Plain: table rows as ``header: cell`` pairs.  Structured: headings of the first two levels in capitals, the header row and rows filled up or cut to its width.
    """
    structured = style == "structured"

    def lines(b: Column) -> Column:
        header = F.get(b["rows"], F.lit(0))
        filled = lambda row: F.array_join(F.transform(header, lambda h, i: F.coalesce(F.get(row, i), F.lit(""))), " | ")
        heading = F.when(b["level"] <= 2, F.upper(b["text"])).otherwise(b["text"]) if structured else b["text"]
        return F.when(b["kind"] == "table", F.transform(b["rows"], filled) if structured else labelled_rows(b["rows"])).otherwise(
            F.array(F.when(b["kind"] == "heading", heading).when(b["kind"] == "bullet", F.concat(F.lit("- "), b["text"])).otherwise(b["text"]))
        )

    return F.regexp_replace(F.array_join(F.filter(F.flatten(F.transform(blocks, lines)), lambda x: x != ""), "\n\n"), r"^\s+|\s+$", "")


def blocks_to_text(blocks: DataFrame, style: str = "plain") -> DataFrame:
    """One text per document of ``text_of`` its blocks."""
    ordered = F.array_sort(F.collect_list(F.struct("block", "kind", "level", "text", "rows")))
    return blocks.groupBy("doc_id").agg(text_of(ordered, style).alias("text"))


def markdown_to_text(docs: DataFrame, style: str = "plain") -> DataFrame:
    """``blocks_to_text`` of the blocks of each document, which stay in its row; a document without blocks has none."""
    text = let(blocks_of(F.col("text")), lambda bs: F.when(F.size(bs) > 0, F.array(text_of(bs, style))))
    return docs.select("doc_id", F.explode(text).alias("text"))


def chat_blocks_table(messages: DataFrame, most: int = 320) -> DataFrame:
    """chat_id, message, role, kind, order, content: the blocks of every message, numbered ``block.part``; rows of a table as ``header: cell`` pairs, other texts in parts of ``most`` characters."""
    key = F.struct("chat_id", "message", F.upper(F.coalesce("role", F.lit("user"))).alias("role"))
    table = F.col("kind") == "table"
    parts = F.when(table, labelled_rows()).otherwise(split_parts(F.col("text"), most))
    made = markdown_blocks(messages.select(key.alias("doc_id"), "text"))
    each = made.select("doc_id.*", F.concat(F.initcap("kind"), F.when(table, " Row").otherwise("")).alias("kind"), "block", F.posexplode(parts).alias("part", "content"))
    return each.select("chat_id", "message", "role", "kind", F.concat_ws(".", (F.col("block") + 1).cast("string"), (F.col("part") + 1).cast("string")).alias("order"), "content")


def _told(b: Column) -> Column:
    tabs = F.length(F.regexp_replace(b["text"], r"[^\t]", ""))
    return (b["kind"] != "table") & ~F.contains(b["text"], F.lit("|")) & (tabs < 2) & (b["text"] != "")


def comparison_narrative(blocks: DataFrame) -> DataFrame:
    """doc_id, narrative: what a comparison says beside its tables; a block with a pipe or two tabs is left out."""
    told = blocks.where(_told(F.struct("kind", "text")))
    return told.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n\n").alias("narrative"))


def markdown_narrative(docs: DataFrame) -> DataFrame:
    """``comparison_narrative`` of the blocks of each document, which stay in its row; a document without such blocks has none."""
    told = F.transform(F.filter(blocks_of(F.col("text")), _told), lambda b: b["text"])
    return docs.select("doc_id", F.explode(let(told, lambda ts: F.when(F.size(ts) > 0, F.array(F.array_join(ts, "\n\n"))))).alias("narrative"))


def parse_comparison(blocks: DataFrame, papers: DataFrame) -> DataFrame:
    """doc_id, row, dimension ("Comparison" if empty), paper_id, content, synthesis: the table with most rows (first on ties), unpivoted; missing cells are empty."""
    size = F.size("rows")
    best = blocks.where("kind = 'table'").groupBy("doc_id").agg(F.max_by("rows", F.struct(size.alias("s"), (-F.col("block")).alias("b"))).alias("rows"))
    rows = best.select("doc_id", F.posexplode(F.slice("rows", 2, 1_000_000)).alias("row", "c"))
    n = papers.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
    cell = lambda i: F.regexp_replace(F.regexp_replace(F.coalesce(F.get("c", i), F.lit("")), r"<br ?/?>", "\n"), r"^\s+|\s+$", "")
    each = rows.join(n, "doc_id").join(papers.select("doc_id", "paper_id", "place"), "doc_id")
    return each.select("doc_id", "row", F.coalesce(F.nullif(cell(F.lit(0)), F.lit("")), F.lit("Comparison")).alias("dimension"), "paper_id", cell(F.col("place").cast("int")).alias("content"), cell(F.col("n") + 1).alias("synthesis"))


def flatten_citations(messages: DataFrame) -> DataFrame:
    """One row per verification item of a message's JSON results."""
    kind = "array<struct<claim:string,score:double,confidence:string,paragraph_id:string>>"
    return messages.select("message_id", F.posexplode(F.from_json("results", kind)).alias("item", "r")).select("message_id", "item", "r.*")


def paper_fields(papers: DataFrame, fields: list[str], most: int = 280) -> DataFrame:
    """paper_id, field, part, content: every field in parts of ``most`` characters; an empty one has one empty part."""
    each = papers.unpivot("paper_id", fields, "field", "text")
    parts = each.select("paper_id", "field", F.posexplode(split_parts(F.coalesce("text", F.lit("")), most)).alias("part", "content"))
    return parts.withColumn("part", F.col("part") + 1)


def table_region(captions: DataFrame, images: DataFrame, reach: float = 250.0, margin: float = 30.0) -> DataFrame:
    """doc_id, page, caption, y0, y1: the area of a table by its caption; below the caption if images lie above it only, else above."""
    near = captions.join(images.select("doc_id", "page", F.col("y0").alias("iy0"), F.col("y1").alias("iy1")), ["doc_id", "page"], "left")
    sides = near.groupBy("doc_id", "page", "caption", "y0", "y1").agg(F.coalesce(F.bool_or(F.col("iy1") <= F.col("y0")), F.lit(False)).alias("above"), F.coalesce(F.bool_or(F.col("iy0") >= F.col("y1")), F.lit(False)).alias("below"))
    under = F.col("above") & ~F.col("below")
    return sides.select("doc_id", "page", "caption", F.when(under, F.col("y0") - margin).otherwise(F.greatest(F.lit(0.0), F.col("y0") - reach)).alias("top"), F.when(under, F.col("y1") + reach).otherwise(F.col("y1") + margin).alias("bottom"))


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\w\s]", " "), r"\s+", " "))


def _searched(needle: Column, kind: Column, fallback: Column) -> list[Column]:
    """What items are held against: visual, short (fewest characters of a word), needle, wide, and the words of both."""
    uncited = lambda c: _plain(F.regexp_replace(F.coalesce(c, F.lit("")), CITATION_ANY, " "))
    visual = F.coalesce(kind, F.lit("text")).isin("table", "figure")
    return [visual.alias("visual"), F.when(visual, 2).otherwise(3).alias("short"), uncited(needle).alias("needle"), uncited(fallback).alias("wide")]


def _words(c: str) -> Column:
    return F.filter(F.split(c, " "), lambda w: F.length(w) >= F.col("short"))


def _marked(pairs: DataFrame) -> DataFrame:
    """doc_id, page, item_idx, marked of items beside what ``_searched`` gives and ``needle_words``, ``wide_words``."""
    closed = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    joined = pairs.withColumn("plain", _plain(F.col("item"))).withColumn("ws", _words("plain"))

    def within(text: str, has: str, least: Column) -> Column:
        found = F.size(F.filter("ws", lambda w: F.array_contains(has, w)))
        contained = (F.length("plain") >= least) & F.contains(closed(F.col(text)), closed(F.col("plain")))
        return contained | ((found >= F.when(F.col("visual"), 1).otherwise(2)) & (found / F.size("ws") >= F.when(F.col("visual"), 0.2).otherwise(0.3)))

    number = F.col("item").rlike(r"\d") & (F.length(F.trim("item")) <= 10) & (F.col("plain") != "") & F.contains("needle", "plain")
    by_words = within("needle", "needle_words", F.when(F.col("visual"), 3).otherwise(4)) | within("wide", "wide_words", F.lit(4))
    searched = (F.size("needle_words") > 0) | (F.size("wide_words") > 0)
    return joined.select("doc_id", "page", "item_idx", F.when(searched, number | F.when(F.size("ws") > 0, by_words).otherwise(False)).otherwise(False).alias("marked"))


def highlight_items(items: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, page, item_idx, marked: items of a page that belong to a span's text; ``spans`` has needle, kind and fallback, a wider text or null.

    Marked: an item with a digit and at most 10 characters that the text has; one that is contained, blanks ignored, from 4 characters on (3 for tables and figures); one with at least two words and 30 % of its words in the text
    (one and 20 % for tables and figures).  Words of under 3 (2) characters and punctuation do not count.  The fallback is searched in the same way, from 4 characters on.
    """
    texts = spans.select("doc_id", "page", *_searched(F.col("needle"), F.col("kind"), F.col("fallback"))).withColumns({"needle_words": _words("needle"), "wide_words": _words("wide")})
    return _marked(items.select("doc_id", "page", "item_idx", "item").join(texts, ["doc_id", "page"]))


def highlight_pages(pages: DataFrame) -> DataFrame:
    """``highlight_items`` where a page and its span are one row: doc_id, page, items array<struct<item_idx, item>>, needle, kind and fallback. Pages never meet, so nothing is shuffled."""
    texts = pages.select("doc_id", "page", "items", *_searched(F.col("needle"), F.col("kind"), F.col("fallback"))).withColumns({"needle_words": _words("needle"), "wide_words": _words("wide")})
    return _marked(texts.select("*", F.inline("items")).drop("items"))
