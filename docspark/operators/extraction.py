"""Sections, tables, figures, formulas and metadata from page, line and box tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.text import CITATION, let, token_count

# Heading patterns, tried in this order; the least number of headings; the group that holds the title.
HEADINGS = [
    ("markdown", r"^(#{1,4})\s+(.+)$", 1, 2), ("chapter", r"^(?:Chapter|CHAPTER)\s+(\d+|[IVXLC]+|[A-Za-z]+)(?:\s*[:.–—]\s*|\s+)([A-Z][A-Za-z\s:,\-–—]+)$", 1, 2),
    ("numbered", r"^(\d+(?:\.\d+)*)\s+([A-Z][A-Za-z\s:,\-–—]+)$", 1, 2), ("roman", r"^([IVXLC]+)[.\)]\s+([A-Z][A-Za-z\s:,\-–—]+)$", 2, 2),
    ("bold_parts", r"^\*{2}(\d+(?:\.\d+)*|[IVXLC]+|[A-Z])[.\)\s]*\*{2}\s*\*{2}([^*\n]+)\*{2}\s*$", 2, 2), ("bold_numbered", r"^\*{2}(\d+(?:\.\d+)*|[IVXLC]+|[A-Z])[.\)\s]+([A-Z][^*\n]+)\*{2}\s*$", 2, 2),
    ("bold_named", r"^\*{2}([A-Z][A-Za-z\s]{2,60})\*{2}\s*$", 1, 1), ("capitals", r"^([A-Z][A-Z\s]{2,50})$", 3, 1),
]
# Names of sections.
SECTIONS = (
    "abstract,introduction,background,related work,related works,methodology,methods,method,approach,proposed method,experimental setup,experiments,experiment,evaluation,results,result,discussion,analysis,"
    "conclusion,conclusions,summary,future work,references,bibliography,acknowledgments,acknowledgements,appendix,appendices,supplementary material,literature review,theoretical framework,data collection,findings,"
    "implications,limitations,recommendations,case study,case studies,implementation,design,overview,problem statement,research questions,materials and methods,procedures,ethical considerations,table of contents,"
    "list of figures,list of tables,dedication,preface,glossary,abbreviations,executive summary,scope,objectives,contributions"
).split(",")
#: Two to five words of capitals: a person's name, if it is not the name of a section.
NAME_IN_CAPITALS = r"^[A-Z]{2,}(?:\s+[A-Z]{2,}){1,4}$"
# What counts as a formula.
SYMBOLS = (
    r"(?:\\(?:frac|sqrt|sum|prod|int|partial|nabla|infty|alpha|beta|gamma|delta|epsilon|theta|lambda|mu|sigma|omega|phi|psi|pi|mathbb|mathcal|mathbf|mathrm|hat|bar|tilde|vec|dot|ddot|left|right|Big|big|"
    r"lim|max|min|sup|inf|log|ln|exp|sin|cos|tan|leq|geq|neq|approx|equiv|sim|propto|forall|exists|in|subset|cup|cap)|[∑∏∫∂∇∞≈±÷√∀∃⊂⊃∪∩])"
)
DISPLAY = r"(?s)\$\$(.+?)\$\$"
ENVIRONMENT = "(?s)" + "|".join(rf"\\begin\{{{e}\*?\}}.+?\\end\{{{e}\*?\}}" for e in ("equation", "align", "gather", "multline", "eqnarray"))
NUMBERED = r"(?m)^\s*\((\d+(?:\.\d+)*)\)\s*(.+)$"
UNICODE = "∑∏∫∂∇∞≈±÷√∀∃⊂⊃∪∩"
TABLE_FRAGMENT = r"[|].*[|]|<br>|<tr|<td|<th|^[\s✓✗×☑☐●○◯■□▪▫\-–—|,.\d]+$"
DOI = r"(?i)(?:doi[:\s]*|https?://(?:dx\.)?doi\.org/)?(10\.\d{4,9}/[^\s,;\"')\]]+)"
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"


def plausible_section(name: Column) -> Column:
    """The name of a known section, one in capitals, or up to 8 words of which every one of over 3 letters, at least one, has a capital."""
    ws = F.array_remove(F.split(name, r"\s+"), "")
    long = F.filter(ws, lambda w: F.length(w) > 3)
    return F.lower(name).isin(SECTIONS) | (name == F.upper(name)) | ((F.size(ws) <= 8) & (F.size(long) > 0) & F.forall(long, lambda w: w.rlike("^[A-Z]")))


def is_heading(line: Column, rule: str) -> Column:
    _, pattern, _, group = next(h for h in HEADINGS if h[0] == rule)
    name = F.trim(F.regexp_extract(line, pattern, group))
    extra = {"bold_named": plausible_section(name), "capitals": F.lower(name).isin(SECTIONS) | ~name.rlike(NAME_IN_CAPITALS)}
    return line.rlike(pattern) & extra.get(rule, F.lit(True))


def split_sections(lines: DataFrame) -> DataFrame:
    """doc_id, order, title, level, content: the first heading rule with enough headings splits the whole document; none gives one section.

    Needs doc_id, line_no, text.  Flags by line, counts by document, then gaps and islands; text before the first heading is dropped.
    """
    doc = Window.partitionBy("doc_id")
    flags = {f"_{name}": is_heading(F.col("text"), name) for name, *_ in HEADINGS}
    counted = lines.select("doc_id", "line_no", "text").withColumns(flags).withColumns({f"_n_{name}": F.count_if(F.col(f"_{name}")).over(doc) for name, *_ in HEADINGS})
    rule, heading, title, level = F.lit(None).cast("string"), F.lit(False), F.lit(None).cast("string"), F.lit(1)
    for name, pattern, least, group in reversed(HEADINGS):
        ok = F.col(f"_n_{name}") >= least
        rule, heading = F.when(ok, name).otherwise(rule), F.when(ok, F.col(f"_{name}")).otherwise(heading)
        title = F.when(ok, F.regexp_extract("text", pattern, group)).otherwise(title)
        level = F.when(ok, F.length(F.regexp_extract("text", pattern, 1)) if name == "markdown" else F.lit(1)).otherwise(level)
    flagged = counted.select("doc_id", "line_no", "text", rule.alias("rule"), heading.alias("h"), title.alias("title"), level.alias("level"))
    flagged = flagged.withColumn("section", F.sum(F.col("h").cast("int")).over(doc.orderBy("line_no")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("h"), F.struct("line_no", "text")))), lambda x: x["text"]), "\n")
    out = flagged.groupBy("doc_id", "section").agg(F.first("rule").alias("rule"), F.max(F.when(F.col("h"), F.trim("title"))).alias("title"), F.max(F.when(F.col("h"), F.col("level"))).alias("level"), F.trim(body).alias("content"))
    out = out.where(F.col("rule").isNull() | ((F.col("section") > 0) & (F.col("content") != "")))
    whole = F.col("rule").isNull()
    return out.select("doc_id", F.when(whole, 0).otherwise(F.col("section") - 1).cast("long").alias("order"), F.when(whole, "Full Document").otherwise(F.col("title")).alias("title"), F.when(whole, 1).otherwise(F.col("level")).alias("level"), "content")


# What a cell may hold without being text, what a table of signs is made of, and captions of tables.
NO_TEXT = r"[\s✓✗×☑☐●○◯■□▪▫\-–—<>br/]"
ONLY_SIGNS = r"^[\s✓✗×☑☐●○◯■□▪▫\-–—|,.\d<>br/]+$"
TABLE_CAPTION = r"(?i)table\s+(\d+)[.:]?\s*(.*)"
SEPARATOR_ROW = r"^\|[\s\-:|]+\|$"


def data_rows(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~F.trim(x).rlike(SEPARATOR_ROW))


def columns_of(rows: Column) -> Column:
    """Number of columns by the pipes of the first row, at least 1."""
    return F.greatest(F.lit(1), F.regexp_count(F.get(rows, F.lit(0)), F.lit(r"\|")) - 1)


def has_content(rows: Column, share: float = 0.15) -> Column:
    """Rows of which at least ``share`` of the cells hold more than one character of text, and which are not signs and digits only."""
    inner = lambda row: F.transform(F.slice(row, 2, F.greatest(F.lit(0), F.size(row) - 2)), lambda c: F.trim(c))
    cells = F.flatten(F.transform(F.transform(rows, lambda r: F.split(r, r"\|")), inner))
    filled = lambda a: F.size(F.filter(a, lambda c: F.length(F.regexp_replace(c, NO_TEXT, "")) > 1))
    return let(cells, lambda a: (F.size(a) > 0) & (filled(a) >= share * F.size(a)) & ~F.array_join(a, " ").rlike(ONLY_SIGNS))


def extract_md_tables(lines: DataFrame) -> DataFrame:
    """doc_id, number, first_line, rows, cols, caption, content: runs of at least two pipe lines with two rows and columns or more and with content.

    The caption is the nearest "Table n" in the last five lines before the table, blank ones at the end not counted, and at most 300 characters away; else the table's number in its document.
    """
    doc = Window.partitionBy("doc_id").orderBy("line_no")
    before = doc.rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.select("doc_id", "line_no", "text", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).alias("start"))
    named = F.concat(F.lit("Table "), F.regexp_extract("text", TABLE_CAPTION, 1), F.lit(": "), F.trim(F.regexp_extract("text", TABLE_CAPTION, 2)))
    at = F.col("start") + F.regexp_instr("text", F.lit(TABLE_CAPTION)) - 1
    caption = F.when(F.col("text").rlike(TABLE_CAPTION), F.struct("line_no", at.alias("at"), F.regexp_replace(named, r"[:\s]+$", "").alias("text")))
    filled = F.when(F.trim("text") != "", F.col("line_no"))
    seen = placed.withColumns({"caption": caption, "filled": filled}).withColumns({"caption": F.last("caption", True).over(before), "filled": F.last("filled", True).over(before)})
    piped = seen.where(F.col("text").rlike(r"^\|.+\|[ \t]*$")).withColumn("island", F.col("line_no") - F.row_number().over(doc))
    runs = piped.groupBy("doc_id", "island").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("lines"), F.min("line_no").alias("first_line"), F.min("start").alias("start"), F.min_by("caption", "line_no").alias("c"), F.min_by("filled", "line_no").alias("filled")
    )
    sized = runs.withColumn("data", data_rows(F.col("lines"))).withColumns({"rows": F.size("data"), "cols": columns_of(F.col("data"))})
    kept = sized.where((F.size("lines") >= 2) & (F.col("rows") >= 2) & (F.col("cols") >= 2) & has_content(F.col("data")))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("first_line"))
    near = (F.col("c.line_no") > F.col("filled") - 5) & (F.col("start") - F.col("c.at") <= 300)
    text = F.when(near, F.col("c.text")).otherwise(F.concat(F.lit("Table "), F.col("number").cast("string")))
    return kept.withColumn("number", number).select("doc_id", "number", "first_line", "rows", "cols", text.alias("caption"), F.trim(F.array_join("lines", "\n")).alias("content"))


def tables_from_boxes(boxes: DataFrame, pages: DataFrame, others: DataFrame) -> DataFrame:
    """doc_id, number, page, content of tables: the piece of the page text that a layout box of a table spans, and ``others`` (doc_id, page, source, ord, content), such as tables of the text or of a raw parser.

    All must have 10 characters, two rows of data, two columns and content; they are numbered by page, boxes first, then by source and place.
    """
    joined = boxes.where("kind = 'table'").join(pages, ["doc_id", "page"])
    content = F.substring(F.col("text"), F.col("pos_start") + 1, F.col("pos_end") - F.col("pos_start"))
    spanned = joined.select("doc_id", "page", F.lit(0).alias("source"), F.col("pos_start").cast("long").alias("ord"), content.alias("content"))
    every = spanned.unionByName(others.select("doc_id", "page", "source", F.col("ord").cast("long").alias("ord"), "content")).withColumn("content", F.regexp_replace("content", r"^\s+|\s+$", ""))
    rows = data_rows(F.filter(F.split("content", "\n"), lambda x: F.trim(x) != ""))
    kept = every.withColumn("data", rows).where((F.length("content") >= 10) & (F.size("data") >= 2) & (columns_of(F.col("data")) >= 2) & has_content(F.col("data")))
    return kept.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "source", "ord")).alias("number"), "page", "content")


def merge_tables(texts: DataFrame, natives: DataFrame) -> DataFrame:
    """doc_id, number, page, y0, content of the tables of two readers (doc_id, ord, page, y0, content; y0 is null without a box), each once by its first 200 characters.

    The first counts, those of the text before the native ones; the first native one with a box replaces one without.  Numbers go by page and y0 (0 without a box), then by the place of the first.
    Tables of one place follow each other by page, box (those without one last) and content, so the order of the rows never matters.
    """
    key = F.trim(F.substring("content", 1, 200))
    columns = ["ord", "page", "y0", "content"]
    no_box = F.col("y0").isNull()
    first = texts.groupBy("doc_id", key.alias("key")).agg(F.min_by(F.struct(*columns), F.struct("ord", "page", no_box, "y0", "content")).alias("r")).select("doc_id", "key", "r.*", F.lit(0).alias("source"))
    both = first.unionByName(natives.select("doc_id", key.alias("key"), *columns, F.lit(1).alias("source")))
    place = F.struct("source", "ord")
    best = F.min_by(F.struct("page", "y0", "content"), F.struct(no_box, place, "page", "y0", "content"))
    merged = both.groupBy("doc_id", "key").agg(best.alias("t"), F.min(place).alias("place")).select("doc_id", "t.*", "place")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", F.coalesce("y0", F.lit(0.0)), "place", "content"))
    return merged.select("doc_id", number.alias("number"), "page", "y0", "content")


def row_boxes(cells: DataFrame) -> DataFrame:
    """Bounding box of every table row; row 0 is the header."""
    return cells.groupBy("table_id", "row").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), (F.min("row") == 0).alias("is_header"))


def first_by_key(df: DataFrame, keys: list[str], has_bbox: str, ord_: str) -> DataFrame:
    """One row per key: the first, unless it has no box and a later one has (tables and figures from two readers); rows of one place go by their other columns, null first."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct((~F.col(has_bbox)).cast("int"), ord_, *rest)).alias("r")).select(*keys, "r.*")


def is_formula(c: Column) -> Column:
    """At least 3 characters, no piece of a table, and symbols, two operators, or a digit with a relation."""
    operators = F.length(F.regexp_replace(c, r"[^+\-*/=<>^_{}()\[\]]", ""))
    return (F.length(c) >= 3) & ~c.rlike(TABLE_FRAGMENT) & (c.rlike(SYMBOLS) | (operators >= 2) | (c.rlike(r"\d") & c.rlike("[=<>≤≥≠≈]")))


def has_maths(c: Column) -> Column:
    """Symbols, a sub- or superscript, or one sign of maths: an equation of under 200 characters, two operators, or a relation."""
    operators = F.length(F.regexp_replace(c, r"[^+\-*/=<>^_{}()\[\]]", ""))
    return c.rlike(SYMBOLS) | c.rlike(r"[a-z]_\{|[a-z]\^|\\[a-z]+\{") | (c.contains("=") & (F.length(c) < 200)) | (operators >= 2) | c.rlike(r"[\^_{}\\≤≥≠≈]")


def find_formulas(docs: DataFrame) -> DataFrame:
    """doc_id, place, kind, content, number of the formulas in each text: all of one matcher before those of the next.

    ``$$..$$``; environments; lines "(n) .."; ``$..$`` within a line, at most 500 characters; lines with a sign of Unicode maths, 5 to 200 characters, not mostly words.  Every one must be a formula by ``is_formula``.
    """
    text, squeezed = F.coalesce("text", F.lit("")), lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))

    def made(kind: str, found: Column, content, number=None, keep=None, wrap=lambda x, c: c) -> Column:
        each = F.transform(found, lambda m: F.struct(m.alias("m"), squeezed(content(m)).alias("c")))
        each = F.filter(each, lambda x: is_formula(x["c"]) & (F.lit(True) if keep is None else keep(x["c"])))
        no = (lambda m: F.lit(None).cast("string")) if number is None else number
        return F.transform(each, lambda x: F.struct(F.lit(kind).alias("kind"), wrap(x["m"], x["c"]).alias("content"), no(x["m"]).alias("number")))

    name = lambda m: F.regexp_extract(m, r"^\\begin\{(\w+)", 1)
    singles = F.regexp_replace(text, r"\${2,}", "\x01")  # so that a sign that is left stands alone
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: (F.length(x) >= 5) & x.rlike(f"[{UNICODE}]") & ~x.rlike(r"[|].*[|]|<br>|<tr"))
    few_words = lambda c: (F.length(c) <= 200) & ~((F.regexp_count(c, F.lit(r"\b[a-zA-Z]{4,}\b")) > 5) & (F.length(F.regexp_replace(c, f"[^{UNICODE}]", "")) <= 2))
    found = F.concat(
        made("display", F.regexp_extract_all(text, F.lit(DISPLAY), 1), lambda m: m, wrap=lambda m, c: F.concat(F.lit("$$"), c, F.lit("$$"))),
        made("display", F.regexp_extract_all(text, F.lit(ENVIRONMENT), 0), lambda m: F.regexp_replace(m, r"^\\begin\{\w+\*?\}|\\end\{\w+\*?\}$", ""), wrap=lambda m, c: F.concat(F.lit("\\begin{"), name(m), F.lit("}"), c, F.lit("\\end{"), name(m), F.lit("}"))),
        made("numbered", F.regexp_extract_all(text, F.lit(NUMBERED), 0), lambda m: F.regexp_extract(m, NUMBERED, 2), number=lambda m: F.regexp_extract(m, NUMBERED, 1), keep=has_maths),
        made("inline", F.regexp_extract_all(singles, F.lit(r"\$([^\n]+?)\$"), 1), lambda m: F.replace(m, F.lit("\x01"), F.lit("$$")), keep=lambda c: F.length(c) <= 500, wrap=lambda m, c: F.concat(F.lit("$"), c, F.lit("$"))),
        made("unicode", lines, lambda m: m, keep=few_words),
    )
    return docs.select("doc_id", F.posexplode(found).alias("place", "f")).select("doc_id", F.col("place").cast("long"), "f.kind", "f.content", "f.number")


def dedup_formulas(formulas: DataFrame) -> DataFrame:
    """First of equal contents in each document."""
    return formulas.groupBy("doc_id", F.trim("content").alias("content")).agg(F.min("place").alias("place"))


def formula_type_counts(formulas: DataFrame) -> DataFrame:
    kinds = ["display", "inline", "numbered", "unicode"]
    return formulas.groupBy("doc_id").pivot("kind", kinds).count().na.fill(0)


def formula_context(formulas: DataFrame, docs: DataFrame, radius: int = 300) -> DataFrame:
    """doc_id, place, context: last sentence of the ``radius`` characters before and first of those after, at most 500 characters."""
    joined = formulas.join(docs.select("doc_id", "text"), "doc_id")
    at = F.call_function("locate", F.col("content"), F.col("text"))
    start = F.greatest(F.lit(1), at - radius)
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    before, after = trim(F.substring(F.col("text"), start, at - start)), trim(F.substring(F.col("text"), at + F.length("content"), F.lit(radius)))
    parts = F.array(F.element_at(F.split(before, r"(?<=[.!?])\s+"), -1), F.element_at(F.split(after, r"(?<=[.!?])\s+"), 1))
    context = F.substring(F.array_join(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""), " "), 1, 500)
    return joined.select("doc_id", "place", F.when(at > 0, context).otherwise("").alias("context"))


def box_captions(boxes: DataFrame, near: float = 40.0) -> DataFrame:
    """Caption of each picture: the first caption box of its page whose top is within ``near`` of the picture's top or bottom.

    A band join on (doc, page): both sides of one page meet, nothing else does.
    """
    pictures = boxes.where("kind = 'picture'").select("doc_id", "page", F.col("box_idx").alias("picture"), F.col("y0").alias("top"), F.col("y1").alias("bottom"))
    captions = boxes.where("kind = 'caption'").select("doc_id", "page", F.col("box_idx").alias("caption_idx"), F.col("y0").alias("c"), F.col("text").alias("caption"))
    close = (F.abs(F.col("c") - F.col("top")) < near) | (F.abs(F.col("c") - F.col("bottom")) < near)
    found = pictures.join(captions, ["doc_id", "page"]).where(close).groupBy("doc_id", "page", "picture").agg(F.min_by("caption", "caption_idx").alias("caption"))
    return pictures.select("doc_id", "page", "picture").join(found, ["doc_id", "page", "picture"], "left").withColumn("caption", F.coalesce("caption", F.lit("")))


def drop_small_figures(boxes: DataFrame, ratio: float = 0.03) -> DataFrame:
    return boxes.where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= ratio * F.col("page_area"))


def overlap_join(a: DataFrame, b: DataFrame, share: float = 0.3) -> DataFrame:
    """First box of ``b`` on the same page that covers more than ``share`` of each box of ``a``."""
    x = a.select("doc_id", "page", F.col("box_idx").alias("a_idx"), *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")])
    y = b.select("doc_id", "page", F.col("box_idx").alias("b_idx"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    wide = F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0")
    high = F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0")
    area = (F.col("a_x1") - F.col("a_x0")) * (F.col("a_y1") - F.col("a_y0"))
    return x.join(y, ["doc_id", "page"]).where((wide > 0) & (high > 0) & (wide * high > share * area)).groupBy("doc_id", "page", "a_idx").agg(F.min("b_idx").alias("b_idx"))


# Single words that are companies, and marks of an affiliation.
COMPANY = r"(?i)^(?:apple|google|meta|openai|microsoft|amazon|nvidia|deepmind|anthropic|ibm|intel|adobe|samsung|huawei)$"
AFFILIATION = r"(?i)university|institute|department|school|college|lab|center|centre|faculty|hospital|inc\.|corp\.|ltd\.|@|\.edu|\.ac\.|\.org"
WORD_NOISE = [(r"[\w.+-]+@[\w-]+\.[\w.]+", ""), (r"[\d†‡§¶∗◦·•\[\]{}<>]", ""), (r"\*+[a-zA-Z]?", "")]


def group_words(words: DataFrame, gap: float = 100.0, height: float = 50.0) -> DataFrame:
    """doc_id, row, name_idx, name: words by rows, then joined into one name while the gap to the word before is less than ``gap``.

    A row holds what lies within ``height`` of the vertical middle of its first word; the tops of the rows of a page are found in one pass over its middles.  Marks, digits and addresses are cut from words;
    names under 3 characters, companies and affiliations are left out.  ``words`` has doc_id, word_idx, x0, x1, y0, y1, text.
    """
    middle = ((F.col("y0") + F.col("y1")) / 2).alias("middle")
    clean = F.col("text")
    for pattern, to in WORD_NOISE:
        clean = F.regexp_replace(clean, pattern, to)
    each = words.select("doc_id", "word_idx", "x0", "x1", middle, F.trim(clean).alias("text"))
    tops = F.aggregate(F.array_sort(F.collect_set("middle")), F.array().cast("array<double>"), lambda rows, y: F.when((F.size(rows) > 0) & (y - F.element_at(rows, -1) <= height), rows).otherwise(F.array_append(rows, y)))
    rows = each.groupBy("doc_id").agg(tops.alias("tops"))
    placed = each.join(rows, "doc_id").withColumn("row", F.size(F.filter("tops", lambda t: t <= F.col("middle"))) - 1)
    w = Window.partitionBy("doc_id", "row").orderBy("x0", "word_idx", "text")
    new = F.coalesce((F.col("x0") - F.lag("x1").over(w) >= gap).cast("int"), F.lit(1))
    grouped = placed.withColumn("new", new).withColumn("name_idx", F.sum("new").over(w))
    name = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_idx", "text"))), lambda s: s["text"]), lambda t: t != ""), " ")
    named = grouped.groupBy("doc_id", "row", "name_idx").agg(name.alias("name"))
    return named.where((F.length("name") >= 3) & ~F.col("name").rlike(COMPANY) & ~F.col("name").rlike(AFFILIATION))


def parse_vision_text(raw: Column) -> tuple[Column, Column]:
    """Type and description of a model's answer: its last TYPE: and DESCRIPTION: lines, else "unknown" and the answer itself."""
    lines = F.transform(F.split(raw, "\n"), lambda x: F.trim(x))

    def last(name: str) -> Column:
        hits = F.filter(lines, lambda x: F.upper(x).startswith(f"{name}:"))
        return F.trim(F.substring(F.try_element_at(hits, F.lit(-1)), len(name) + 2, 1 << 30))

    return F.coalesce(F.lower(last("TYPE")), F.lit("unknown")), F.coalesce(last("DESCRIPTION"), raw)


def extract_year(text: Column, meta: Column) -> Column:
    """Year of the file's dates, else a year after a publishing word, else after a month, else any, in the first 5000 characters."""
    head = F.substring(text, 1, 5000)
    year = lambda c, p, g=1: F.when(F.regexp_extract(c, p, g) != "", F.regexp_extract(c, p, g).cast("int"))
    of_file = F.coalesce(year(meta, r"D:(\d{4})"), year(meta, r"((?:19|20)\d{2})"))
    after_word = year(head, r"(?i)(?:©|copyright|published|received|accepted|submitted|\(|,\s*)\s*((?:19|20)\d{2})\b")
    return F.coalesce(F.when(of_file.between(1900, 2100), of_file), after_word, year(head, rf"(?i)(?:{MONTHS})[\s.,]+(?:\d{{1,2}}[\s.,]+)?((?:19|20)\d{{2}})"), year(head, r"\b((?:19|20)\d{2})\b"))


def extract_doi(text: Column, meta: Column) -> Column:
    one = lambda c: F.nullif(F.regexp_replace(F.regexp_extract(c, DOI, 1), r"\.+$", ""), F.lit(""))
    return F.coalesce(one(meta), one(F.substring(text, 1, 8000)))


def extract_abstract(text: Column) -> Column:
    """The text after the first "Abstract" up to the next heading, cleaned, if it has 31 to 4999 characters."""
    after = F.regexp_extract(F.substring(text, 1, 20_000), r"(?is)[_*]*\bAbstract\b[_*]*(.*)", 1)
    after = F.regexp_replace(F.regexp_replace(after, r"^[^\S\n]*[_*—\-:.]+[^\S\n]*", ""), r"^\s+", "")
    end = r"(?i)\n\s*#{1,3}\s|\n\s*[_*]{0,4}(?:1[\s.]|I[\s.]|Introduction|Keywords|Index\s+Terms|CCS\s+Concepts)[_*]{0,4}|\n\s*\n\s*\n"
    body = F.substring(F.get(F.split(after, end, 2), F.lit(0)), 1, 3000)
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(body), r"^[_*—\s.]+", ""), r"\n+", " "), r"\s{2,}", " ")
    return F.when((F.length(clean) > 30) & (F.length(clean) < 5000) & ~clean.rlike(r"^(?i)(?:Keywords?|Index\s+Terms|CCS\s+Concepts)\b"), clean)


def figure_chunk(title: Column, page: Column, kind: Column, caption: Column, description: Column) -> tuple[Column, Column]:
    """Display and enriched text of a figure."""
    has = F.coalesce(caption, F.lit("")) != ""
    prefix = F.concat_ws(" ", F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("["), title, F.lit("]"))), F.concat(F.lit("[Figure on page "), page.cast("string"), F.lit(", type: "), kind, F.lit("]")), F.when(has, F.concat(F.lit("[Caption: "), caption, F.lit("]"))))
    return F.concat(prefix, F.lit(" "), F.when(has, F.concat(caption, F.lit("\n"), description)).otherwise(description)), F.concat(prefix, F.lit(" "), description)


def table_chunk(title: Column, page: Column, rows: Column, cols: Column, caption: Column, content: Column) -> tuple[Column, Column]:
    """Display and enriched text of a table; the enriched one has a sentence on what it holds."""
    s = lambda c: c.cast("string")
    has = F.coalesce(caption, F.lit("")) != ""
    prefix = F.concat_ws(" ", F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("["), title, F.lit("]"))), F.concat(F.lit("[TABLE, page "), s(page), F.lit(", "), s(rows), F.lit(" rows × "), s(cols), F.lit(" cols]")), F.when(has, F.concat(F.lit("[Caption: "), caption, F.lit("]"))))
    about = F.concat_ws(" ", F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("This table is from the paper '"), title, F.lit("'."))), F.when(has, F.concat(F.lit("It presents: "), caption, F.lit("."))), F.when((rows > 0) | (cols > 0), F.concat(F.lit("The table contains "), s(rows), F.lit(" data rows across "), s(cols), F.lit(" columns."))))
    display = F.concat_ws("\n", prefix, F.when(has, caption), content)
    return display, F.concat_ws("\n", prefix, F.when(about != "", about), content)


def route_vision(kind: Column) -> Column:
    """Where a described figure goes: table, formula or figure."""
    low = F.lower(kind)
    return F.when(low.rlike("table|tabular|spreadsheet|grid"), "table").when(low.rlike("equation|formula|mathematical|math expression"), "formula").otherwise("figure")


# What is cut from a source before it is shown.
CAPTION = r"\[Caption:\s*(.+?)\]"
METADATA = r"^\s*(?:\[[^\]]*\]\s*)+"
DESCRIPTION = r"(?i)This (?:table|figure) is from the paper\s*'.+?'\.\s*(?:It presents:.*?\.)?\s*(?:The table contains.*?columns\.)?\s*"
RULE_ROW = r"^\|[\s\-:|]+\|$"


def display_source(text: Column, kind: Column, most: int = 300) -> Column:
    """A source as shown, without citations and at most ``most`` characters.

    Table: caption and first header row, or the first line; figure: caption, or a first line that names a figure; formula: the first two lines that are no headings.  Where that is empty the text stays whole.
    """
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    lines = lambda c: F.transform(F.split(c, "\n"), strip)

    def of(clean: Column) -> Column:
        caption, bare = strip(F.regexp_extract(clean, CAPTION, 1)), strip(F.regexp_replace(clean, METADATA, ""))
        table = let(strip(F.regexp_replace(bare, DESCRIPTION, "")), lambda t: F.when(caption != "", F.concat_ws("\n", caption, F.get(F.filter(lines(t), lambda x: x.startswith("|") & ~x.rlike(RULE_ROW)), F.lit(0)))).otherwise(F.get(lines(t), F.lit(0))))
        first = F.get(lines(bare), F.lit(0))
        figure = F.when(caption != "", F.regexp_replace(caption, r"\*{1,3}(.+?)\*{1,3}", "$1")).when(first.rlike(r"Figure|Fig\."), first).otherwise("Figure/Image Content")
        formula = F.array_join(F.slice(F.filter(lines(bare), lambda x: (x != "") & ~x.startswith("##")), 1, 2), " ")
        result = F.when(kind.isNull() | (kind == "text"), clean).when(kind == "table", table).when(kind == "figure", figure).when(kind == "formula", formula).otherwise(bare)
        return let(result, lambda r: F.when(r == "", clean).when(F.length(r) > most, F.concat(F.regexp_replace(F.substring(r, 1, most), r"\s+$", ""), F.lit("..."))).otherwise(r))

    return let(strip(F.regexp_replace(text, CITATION, "")), of)


def chunk_tokens(df: DataFrame) -> DataFrame:
    return df.withColumn("token_count", token_count(F.col("text")))
