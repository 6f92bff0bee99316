"""Queries over extracted structure, answers and exports; inputs are lines and boxes made from the order and part tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.operators import answers, extraction, library, verification
from docspark.plans import fixtures as fx
from docspark.plans.fixtures import table
from docspark.plans.registry import query

KEY = "CAST(o_orderkey AS VARCHAR)"


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


#: Headings of every rule, tables, and what looks like either, put over the documents' lines.
MD_EDGES = [
    ["Preface", "# Intro", "Body", "## Methods and more", "More", "text"], ["Chapter 1 Start", "Text", "CHAPTER Two: End", "Tail"], ["I. First part", "abc", "II. Second part", "", "x"], ["I. Only one", "abc"],
    ["plain", "| a | b |", "|---|---|", "| 1 | 2 |", "| x | y |", "end", "| no | table |"], ["before", "1 Introduction", "a", "1.2 More: of it", "b", "2 no capital"],
    ["**1.** **First: of all**", "a", "**II** **Second**", "b"], ["**1. One**", "a", "**B) Two**", "b", "**C lower**", "**D. **"], ["**3. Alone**", "**Related Work**", "a", "**Some of the words here**", "b", "**Results**  ", "c"],
    ["ABSTRACT", "a", "JOHN SMITH", "b", "RELATED WORK", "c", "DATA", "d"], ["ABSTRACT", "a", "MARY ANN SMITH", "b", "RESULTS", "c"], ["**lower case**", "**Ab**", "#no", "##### five", "A", "AB"],
    ["Table 3: Results of it ", "", "", "| aa | bb |", "|---|---|", "| 1 | 2 |", "mid", "| cc | dd |", "| 3 | 4 |"], ["table 4.", "x", "| 1 | 2 |", "| 3 | 4 |", "", "| ✓ | ok then |", "| ✗ | - |", "|x|"], ["Table 5", "a", "b", "c", "d", "e", "| aa | bb |", "| cc | dd | "],
    ["Table 6 " + "long " * 70, "| aa | bb |", "| cc | dd |", "text", "| Table 7 | bb |", "| cc | dd |"],
]
MD_SQL = f"md AS (SELECT doc_id, list_concat([{', '.join(_sql_list(e) for e in MD_EDGES)}][doc_id % {len(MD_EDGES)} + 1], string_split(text, chr(10))) AS ls FROM documents), lines AS (SELECT doc_id, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS line_no FROM md)"


def _md(spark, d):
    edges = F.array(*[F.array(*[F.lit(x) for x in e]) for e in MD_EDGES])
    docs = table(spark, d, "documents").repartition("doc_id")  # sections and tables are put together by document
    return docs.select("doc_id", F.posexplode(F.concat(F.get(edges, (F.col("doc_id") % len(MD_EDGES)).cast("int")), F.split("text", "\n"))).alias("line_no", "text"))


def _heading_sql(name: str) -> str:
    _, pattern, _, group = next(h for h in extraction.HEADINGS if h[0] == name)
    t, known = f"trim(regexp_extract(text, '{pattern}', {group}))", "(" + ", ".join(f"'{x}'" for x in extraction.SECTIONS) + ")"
    words = f"list_filter(string_split_regex({t}, '\\s+'), lambda w: w <> '')"
    long = f"list_filter({words}, lambda w: length(w) > 3)"
    extra = {
        "bold_named": f" AND (lower({t}) IN {known} OR {t} = upper({t}) OR (len({words}) <= 8 AND len({long}) > 0 AND len(list_filter({long}, lambda w: NOT regexp_matches(w, '^[A-Z]'))) = 0))",
        "capitals": f" AND (lower({t}) IN {known} OR NOT regexp_matches({t}, '{extraction.NAME_IN_CAPITALS}'))",
    }
    return f"(regexp_matches(text, '{pattern}'){extra.get(name, '')})"


H = [name for name, *_ in extraction.HEADINGS]
SECTIONS_SQL = f"""WITH {MD_SQL}, f AS (SELECT *, {", ".join(f"{_heading_sql(n)} AS h_{n}" for n in H)} FROM lines),
c AS (SELECT *, {", ".join(f"count(*) FILTER (WHERE h_{n}) OVER (PARTITION BY doc_id) AS n_{n}" for n in H)} FROM f),
r AS (SELECT *, CASE {" ".join(f"WHEN n_{n} >= {least} THEN '{n}'" for n, _, least, _ in extraction.HEADINGS)} END AS rule FROM c),
g AS (SELECT *, CASE rule {" ".join(f"WHEN '{n}' THEN h_{n}" for n in H)} ELSE FALSE END AS h, CASE rule {" ".join(f"WHEN '{n}' THEN regexp_extract(text, '{p}', {k})" for n, p, _, k in extraction.HEADINGS)} END AS title FROM r),
s AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM g),
o AS (SELECT doc_id, section, max(rule) AS rule, max(CASE WHEN h THEN trim(title) END) AS title, max(CASE WHEN h THEN CASE WHEN rule = 'markdown' THEN length(regexp_extract(text, '^(#{{1,4}})\\s', 1)) ELSE 1 END END) AS level, trim(coalesce(string_agg(CASE WHEN NOT h THEN text END, chr(10) ORDER BY line_no), '')) AS content FROM s GROUP BY doc_id, section)
SELECT doc_id, CASE WHEN rule IS NULL THEN 0 ELSE section - 1 END::BIGINT AS "order", CASE WHEN rule IS NULL THEN 'Full Document' ELSE title END AS title, CASE WHEN rule IS NULL THEN 1 ELSE level END AS level, content FROM o WHERE rule IS NULL OR (section > 0 AND content <> '')"""


@query(SECTIONS_SQL)
def d05_split_sections(spark, d):
    return extraction.split_sections(_md(spark, d))


_BEFORE = "WINDOW b AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_LAST = "last_value(CASE WHEN {0} THEN {1} END IGNORE NULLS) OVER b"


def _content_sql() -> str:
    filled = f"len(list_filter(cs, lambda c: length(regexp_replace(c, '{extraction.NO_TEXT}', '', 'g')) > 1))"
    return f"len(cs) > 0 AND {filled} >= 0.15 * len(cs) AND NOT regexp_matches(array_to_string(cs, ' '), '{extraction.ONLY_SIGNS}')"


_CAPTION_OF = f"regexp_replace('Table ' || regexp_extract(text, '{extraction.TABLE_CAPTION}', 1) || ': ' || trim(regexp_extract(text, '{extraction.TABLE_CAPTION}', 2)), '[:\\s]+$', '')"


@query(rf"""WITH {MD_SQL}, st AS (SELECT *, regexp_matches(text, '{extraction.TABLE_CAPTION}') AS hit, coalesce(sum(length(text) + 1) OVER b, 0) AS start FROM lines {_BEFORE}),
c AS (SELECT *, {_LAST.format("hit", "line_no")} AS cl, {_LAST.format("hit", f"start + strpos(text, regexp_extract(text, '{extraction.TABLE_CAPTION}')) - 1")} AS ca, {_LAST.format("hit", _CAPTION_OF)} AS cap, {_LAST.format("trim(text) <> ''", "line_no")} AS filled FROM st {_BEFORE}),
p AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM c WHERE regexp_matches(text, '^\|.+\|[ \t]*$')),
g AS (SELECT doc_id, min(line_no) AS first_line, list(text ORDER BY line_no) AS ls, first(start ORDER BY line_no) AS start, first(cl ORDER BY line_no) AS cl, first(ca ORDER BY line_no) AS ca, first(cap ORDER BY line_no) AS cap, first(filled ORDER BY line_no) AS filled FROM p GROUP BY doc_id, island),
t AS (SELECT *, list_filter(ls, lambda x: NOT regexp_matches(trim(x), '{extraction.SEPARATOR_ROW}')) AS data FROM g), u AS (SELECT *, len(data) AS "rows", greatest(1, len(string_split(data[1], '|')) - 2) AS cols, flatten(list_transform(data, lambda r: list_transform(string_split(r, '|')[2:-2], lambda c: trim(c)))) AS cs FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_line) AS number FROM u WHERE len(ls) >= 2 AND "rows" >= 2 AND cols >= 2 AND {_content_sql()})
SELECT doc_id, number, first_line, "rows", cols, CASE WHEN cl > filled - 5 AND start - ca <= 300 THEN cap ELSE 'Table ' || CAST(number AS VARCHAR) END AS caption, trim(array_to_string(ls, chr(10))) AS content FROM k""")
def x01_extract_md_tables(spark, d):
    return extraction.extract_md_tables(_md(spark, d))


@query("""WITH t AS (SELECT o_orderkey AS doc_id, 0 AS page, 0 AS source, '| a | b |' || chr(10) || '| 1 | ' || o_orderpriority || ' |' AS content FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT o_orderkey, o_orderkey % 2, 2, '| x | y |' || chr(10) || '|---|---|' || chr(10) || '| 1 | word |' FROM orders WHERE o_orderkey % 5 > 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, source) AS number, page, content FROM t""")
def x02_tables_from_boxes(spark, d):
    """A box of a table, one of two letters, and two tables of a raw parser, of which one has digits only."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).cast("long").alias("page"), F.concat(F.lit("head\n| a | b |\n| 1 | "), "o_orderpriority", F.lit(" |\ntail")).alias("text"))
    spans = F.array(F.struct(F.lit(5).alias("pos_start"), (F.length("text") - 5).alias("pos_end")), F.struct(F.lit(0).alias("pos_start"), F.lit(4).alias("pos_end")))
    boxes = orders.select("doc_id", "page", F.when(F.col("doc_id") % 3 > 0, "table").otherwise("text").alias("kind"), F.inline(spans))
    raw = F.array(F.when(F.col("doc_id") % 5 > 0, "\n| x | y |\n|---|---|\n| 1 | word |\n").otherwise("| a |"), F.lit("| 1 | 2 |\n| 3 | 4.5 |"))
    others = orders.select("doc_id", (F.col("doc_id") % 2).alias("page"), F.lit(2).alias("source"), F.posexplode(raw).alias("ord", "content"))
    return extraction.tables_from_boxes(boxes, orders, others)


CELLS_SQL = "cells AS (SELECT l_orderkey AS table_id, l_linenumber - 1 AS \"row\", (l_partkey % 100)::DOUBLE AS x0, (l_suppkey % 70)::DOUBLE AS y0, (l_partkey % 100 + l_quantity)::DOUBLE AS x1, (l_suppkey % 70 + 12)::DOUBLE AS y1 FROM lineitem)"


@query(f'WITH {CELLS_SQL} SELECT table_id, "row", min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, "row" = 0 AS is_header FROM cells GROUP BY table_id, "row"')
def x04_row_boxes(spark, d):
    dbl = lambda c: c.cast("double")
    cells = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") - 1).alias("row"), dbl(F.col("l_partkey") % 100).alias("x0"), dbl(F.col("l_suppkey") % 70).alias("y0"),
        dbl(F.col("l_partkey") % 100 + F.col("l_quantity")).alias("x1"), dbl(F.col("l_suppkey") % 70 + 12).alias("y1"),
    )
    return extraction.row_boxes(cells)


@query("""WITH t AS (SELECT l_orderkey AS doc_id, 'c' || CAST(l_partkey % 5 AS VARCHAR) AS content, l_linenumber * 10000000 + l_partkey AS ord, l_suppkey % 2 AS page, CASE WHEN l_suppkey % 3 > 0 THEN (l_partkey % 50)::DOUBLE END AS y0, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS source FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, content, source ORDER BY ord, page, y0 IS NULL, y0) AS n FROM t), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, content ORDER BY y0 IS NULL, source, ord, page, y0) AS best, min(source * 1000000000000 + ord) OVER (PARTITION BY doc_id, content) AS place FROM f WHERE source = 1 OR n = 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, coalesce(y0, 0), place, content) AS number, page, y0, content FROM k WHERE best = 1""")
def x03_merge_tables(spark, d):
    t = table(spark, d, "lineitem").select(
        "l_returnflag", F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("c"), (F.col("l_partkey") % 5).cast("string")).alias("content"), (F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("ord"), (F.col("l_suppkey") % 2).alias("page"),
        F.when(F.col("l_suppkey") % 3 > 0, (F.col("l_partkey") % 50).cast("double")).alias("y0"),
    )
    return extraction.merge_tables(t.where("l_returnflag = 'N'").drop("l_returnflag"), t.where("l_returnflag <> 'N'").drop("l_returnflag"))


#: Formulas, and what looks like one, put under the documents' texts.
FORMULA_EDGES = [
    "We have $$E_{k} = mc^2$$ so it holds. Then $$xy$$ and $$E_{k}  = mc^2$$ end.", "See \\begin{equation} a + b = c \\end{equation} and \\begin{align*}x &= 1\n y &= 2\\end{align*} here.", "(1.2) x = y + 1\n (3) the plain words of this line\n(4) F = ma",
    "Costs $a_1 + b_2$ or $x$, and $$y^2 = 4$$ with $\\alpha$ left.", "∑ x_i over all i\na long line of very plain words that only mentions ± once\n∫ f(x) dx ≈ 0.5", "| a | b = c |\n$| a | b |$ and <td>1 = 1</td>", "", "$one sign only and $$ no end", "∀x ∃y: x < y\n≈\n1 ± 2 | 3 | 4",
    "\\begin{gather}no\\end{align} \\begin{multline}p = \\frac{1}{2}\\end{multline}",
]


FORMULA_SQL = f"fdocs AS (SELECT doc_id, text || chr(10) || {_sql_list(FORMULA_EDGES)}[doc_id % {len(FORMULA_EDGES)} + 1] AS text FROM documents)"


def _found_sql() -> str:
    e = extraction
    operators = "length(regexp_replace(c, '[^+\\-*/=<>^_{}()\\[\\]]', '', 'g'))"
    formula = f"length(c) >= 3 AND NOT regexp_matches(c, '{e.TABLE_FRAGMENT}') AND (regexp_matches(c, '{e.SYMBOLS}') OR {operators} >= 2 OR (regexp_matches(c, '\\d') AND regexp_matches(c, '[=<>≤≥≠≈]')))"
    maths = f"(regexp_matches(c, '{e.SYMBOLS}') OR regexp_matches(c, '[a-z]_\\{{|[a-z]\\^|\\\\[a-z]+\\{{') OR (contains(c, '=') AND length(c) < 200) OR {operators} >= 2 OR regexp_matches(c, '[\\^_{{}}\\\\≤≥≠≈]'))"
    few = f"length(c) <= 200 AND NOT (len(regexp_extract_all(c, '\\b[a-zA-Z]{{4,}}\\b')) > 5 AND length(regexp_replace(c, '[^{e.UNICODE}]', '', 'g')) <= 2)"
    singles = "regexp_replace(text, '\\${2,}', chr(1), 'g')"
    lines = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) >= 5 AND regexp_matches(x, '[{e.UNICODE}]') AND NOT regexp_matches(x, '[|].*[|]|<br>|<tr'))"
    name = "regexp_extract(m, '^\\\\begin\\{(\\w+)', 1)"
    rules = [
        ("display", f"regexp_extract_all(text, '{e.DISPLAY}', 1)", "m", "true", "'$$' || c || '$$'", "NULL"),
        ("display", f"regexp_extract_all(text, '{e.ENVIRONMENT}')", "regexp_replace(m, '^\\\\begin\\{\\w+\\*?\\}|\\\\end\\{\\w+\\*?\\}$', '', 'g')", "true", f"'\\begin{{' || {name} || '}}' || c || '\\end{{' || {name} || '}}'", "NULL"),
        ("numbered", f"regexp_extract_all(text, '{e.NUMBERED}')", f"regexp_extract(m, '{e.NUMBERED}', 2)", maths, "c", f"regexp_extract(m, '{e.NUMBERED}', 1)"),
        ("inline", f"regexp_extract_all({singles}, '\\$([^\\n]+?)\\$', 1)", "replace(m, chr(1), '$$')", "length(c) <= 500", "'$' || c || '$'", "NULL"),
        ("unicode", lines, "m", few, "c", "NULL"),
    ]
    raw = " UNION ALL ".join(f"SELECT doc_id, {r} AS r, '{kind}' AS kind, unnest({found}) AS m, generate_subscripts({found}, 1) AS i FROM fdocs" for r, (kind, found, *_) in enumerate(rules))
    case = lambda k: "CASE r " + " ".join(f"WHEN {r} THEN {rule[k]}" for r, rule in enumerate(rules)) + " END"
    return (
        f"raw AS ({raw}), squeezed AS (SELECT *, trim(regexp_replace({case(2)}, '\\s+', ' ', 'g')) AS c FROM raw), "
        f"found AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY r, i) - 1 AS place, kind, {case(4)} AS content, {case(5)} AS number FROM squeezed WHERE {formula} AND {case(3)})"
    )


FOUND_SQL = _found_sql()


def _fdocs(spark, d):
    edge = F.get(F.array(*[F.lit(x) for x in FORMULA_EDGES]), (F.col("doc_id") % len(FORMULA_EDGES)).cast("int"))
    return fx.documents(spark, d).select("doc_id", F.concat("text", F.lit("\n"), edge).alias("text"))


@query(f"WITH {FORMULA_SQL}, {FOUND_SQL} SELECT doc_id, place, kind, content, number FROM found")
def x05_extract_formulas(spark, d):
    return extraction.find_formulas(_fdocs(spark, d))


@query(f"WITH {FORMULA_SQL}, {FOUND_SQL} SELECT doc_id, content, min(place) AS place FROM found GROUP BY doc_id, content")
def x07_dedup_formulas(spark, d):
    return extraction.dedup_formulas(extraction.find_formulas(_fdocs(spark, d)))


_AROUND = "list_filter([trim(string_split(regexp_replace(before, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[-1]), trim(string_split(regexp_replace(after, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1])], lambda x: x <> '')"


@query(f"""WITH {FORMULA_SQL}, {FOUND_SQL}, a AS (SELECT f.doc_id, place, f.content, text, strpos(text, f.content) AS pos FROM found f JOIN fdocs USING (doc_id)),
b AS (SELECT *, regexp_replace(substr(text, greatest(1, pos - 300), pos - greatest(1, pos - 300)), '^\\s+|\\s+$', '', 'g') AS before, regexp_replace(substr(text, pos + length(content), 300), '^\\s+|\\s+$', '', 'g') AS after FROM a)
SELECT doc_id, place, CASE WHEN pos > 0 THEN substr(array_to_string({_AROUND}, ' '), 1, 500) ELSE '' END AS context FROM b""")
def x08_formula_context(spark, d):
    return extraction.formula_context(extraction.find_formulas(_fdocs(spark, d)), _fdocs(spark, d))


@query(f"WITH {FORMULA_SQL}, {FOUND_SQL} SELECT doc_id, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in ("display", "inline", "numbered", "unicode")) + " FROM found GROUP BY doc_id")
def x09_formula_type_counts(spark, d):
    return extraction.formula_type_counts(extraction.find_formulas(_fdocs(spark, d)))


BOXES_SQL = "boxes AS (SELECT p_partkey // 12 AS doc_id, p_partkey % 2 AS page, p_partkey AS box_idx, CASE WHEN p_partkey % 3 = 0 THEN 'picture' ELSE 'caption' END AS kind, (p_partkey * 7 % 100)::DOUBLE AS x0, (p_partkey * 13 % 300)::DOUBLE AS y0, (p_partkey * 7 % 100 + 20 + p_size)::DOUBLE AS x1, (p_partkey * 13 % 300 + 30 + p_size)::DOUBLE AS y1, p_name AS text, 100000.0::DOUBLE AS page_area FROM part)"


def _boxes(spark, d):
    k = F.col("p_partkey")
    dbl = lambda c: c.cast("double")
    return table(spark, d, "part").select(
        F.floor(k / 12).alias("doc_id"), (k % 2).alias("page"), k.alias("box_idx"), F.when(k % 3 == 0, "picture").otherwise("caption").alias("kind"), dbl(k * 7 % 100).alias("x0"), dbl(k * 13 % 300).alias("y0"),
        dbl(k * 7 % 100 + 20 + F.col("p_size")).alias("x1"), dbl(k * 13 % 300 + 30 + F.col("p_size")).alias("y1"), F.col("p_name").alias("text"), F.lit(100000.0).alias("page_area"),
    )


@query(f"""WITH {BOXES_SQL}, p AS (SELECT * FROM boxes WHERE kind = 'picture'), c AS (SELECT * FROM boxes WHERE kind = 'caption'),
m AS (SELECT p.doc_id, p.page, p.box_idx AS picture, arg_min(c.text, c.box_idx) AS caption FROM p JOIN c ON c.doc_id = p.doc_id AND c.page = p.page AND (abs(c.y0 - p.y0) < 40 OR abs(c.y0 - p.y1) < 40) GROUP BY 1, 2, 3)
SELECT p.doc_id, p.page, p.box_idx AS picture, coalesce(m.caption, '') AS caption FROM p LEFT JOIN m ON m.doc_id = p.doc_id AND m.page = p.page AND m.picture = p.box_idx""")
def x11_box_captions(spark, d):
    return extraction.box_captions(_boxes(spark, d))


@query(f"WITH {BOXES_SQL} SELECT box_idx FROM boxes WHERE (x1 - x0) * (y1 - y0) >= 0.03 * page_area")
def x12_drop_small_figures(spark, d):
    return extraction.drop_small_figures(_boxes(spark, d)).select("box_idx")


@query(f"""WITH {BOXES_SQL}, x AS (SELECT a.doc_id, a.page, a.box_idx AS a_idx, b.box_idx AS b_idx, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h, (a.x1 - a.x0) * (a.y1 - a.y0) AS area FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND a.page = b.page WHERE a.kind = 'caption' AND b.kind = 'picture')
SELECT doc_id, page, a_idx, min(b_idx) AS b_idx FROM x WHERE w > 0 AND h > 0 AND w * h > 0.3 * area GROUP BY 1, 2, 3""")
def v14_overlap_join(spark, d):
    boxes = _boxes(spark, d)
    return extraction.overlap_join(boxes.where("kind = 'caption'"), boxes.where("kind = 'picture'"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE lower(o_orderstatus) || ' table' END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN 'just ' || o_orderpriority ELSE 'of ' || o_orderpriority END AS description FROM orders")
def x15_parse_vision_text(spark, d):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("just "), "o_orderpriority")).otherwise(F.concat(F.lit("type: old\n TYPE: "), "o_orderstatus", F.lit(" table\ndescription: of "), "o_orderpriority"))
    kind, description = extraction.parse_vision_text(raw)
    return table(spark, d, "orders").select("o_orderkey", kind.alias("kind"), description.alias("description"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 1990 + o_orderkey % 30 WHEN 1 THEN 2001 WHEN 2 THEN 1987 ELSE NULL END AS year, CASE WHEN o_orderkey % 4 = 1 THEN '10.1234/ab.' || CAST(o_orderkey AS VARCHAR) END AS doi FROM orders""")
def x18_x20_year_and_doi(spark, d):
    k, n = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 4
    meta = F.when(n == 0, F.concat(F.lit("D:"), (1990 + F.col("o_orderkey") % 30).cast("string"), F.lit("0102")))
    text = F.when(n == 1, F.concat(F.lit("In 1999 we said. Published 2001, doi: 10.1234/ab."), k, F.lit(". End"))).when(n == 2, "Seen in March 3, 1987 and 2005 again").otherwise("No year 12345")
    return table(spark, d, "orders").select("o_orderkey", extraction.extract_year(text, meta).alias("year"), extraction.extract_doi(text, meta).alias("doi"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'We study ' || o_orderpriority || ' in many ways and at length.' END AS abstract FROM orders")
def x19_extract_abstract(spark, d):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Title\n**Abstract** - We study "), "o_orderpriority", F.lit(" in many\nways and at length.\n\n1. Introduction\nText"))).otherwise("Title only\nIntroduction")
    return table(spark, d, "orders").select("o_orderkey", extraction.extract_abstract(text).alias("abstract"))


@query(rf"""WITH RECURSIVE w AS (SELECT l_orderkey AS doc_id, l_linenumber * 10000000 + l_partkey AS word_idx, (l_linenumber * 70 + l_suppkey % 90)::DOUBLE AS x0, (l_linenumber * 70 + l_suppkey % 90 + 60)::DOUBLE AS x1, (l_partkey % 180 + l_partkey % 180 + 10)::DOUBLE / 2 AS middle,
CASE l_partkey % 7 WHEN 0 THEN 'Google' WHEN 1 THEN '' WHEN 2 THEN 'Lab' ELSE l_returnflag || l_linestatus END AS text FROM lineitem), ys AS (SELECT doc_id, list_sort(list(DISTINCT middle)) AS ys FROM w GROUP BY 1),
tops AS (SELECT doc_id, ys, ys[1] AS top, 0 AS r FROM ys UNION ALL SELECT doc_id, ys, list_filter(ys, lambda y: y - top > 50)[1], r + 1 FROM tops WHERE list_filter(ys, lambda y: y - top > 50)[1] IS NOT NULL),
p AS (SELECT w.doc_id, word_idx, x0, x1, text, max(r) AS "row" FROM w JOIN tops t ON t.doc_id = w.doc_id AND t.top <= w.middle GROUP BY ALL),
n AS (SELECT *, coalesce((x0 - lag(x1) OVER (PARTITION BY doc_id, "row" ORDER BY x0, word_idx, text) >= 20)::INT, 1) AS new FROM p), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, "row" ORDER BY x0, word_idx, text) AS name_idx FROM n),
s AS (SELECT doc_id, "row", name_idx::BIGINT AS name_idx, coalesce(string_agg(text, ' ' ORDER BY x0, word_idx, text) FILTER (WHERE text <> ''), '') AS name FROM g GROUP BY 1, 2, 3)
SELECT * FROM s WHERE length(name) >= 3 AND NOT regexp_matches(name, '{extraction.COMPANY}') AND NOT regexp_matches(name, '{extraction.AFFILIATION}')""")
def x22_group_words(spark, d):
    dbl, n = lambda c: c.cast("double"), F.col("l_partkey") % 7
    x, y = F.col("l_linenumber") * 70 + F.col("l_suppkey") % 90, F.col("l_partkey") % 180
    text = F.when(n == 0, "Google*a").when(n == 1, "me@x.org").when(n == 2, "Lab[2]").otherwise(F.concat("l_returnflag", "l_linestatus", F.lit("1†")))
    words = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("word_idx"), dbl(x).alias("x0"), dbl(x + 60).alias("x1"), dbl(y).alias("y0"), dbl(y + 10).alias("y1"), text.alias("text")
    )
    return extraction.group_words(words, 20.0)


@query(r"""WITH t AS (SELECT p_partkey, '[' || p_brand || '] [Figure on page ' || CAST(p_size AS VARCHAR) || ', type: ' || p_brand || ']' || CASE WHEN p_partkey % 2 = 0 THEN ' [Caption: ' || p_type || ']' ELSE '' END AS p, CASE WHEN p_partkey % 2 = 0 THEN p_type || chr(10) || p_name ELSE p_name END AS body, p_name FROM part)
SELECT p_partkey, p || ' ' || body AS display, p || ' ' || p_name AS enriched FROM t""")
def k04_figure_chunks(spark, d):
    caption = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise("")
    display, enriched = extraction.figure_chunk(F.col("p_brand"), F.col("p_size"), F.col("p_brand"), caption, F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", display.alias("display"), enriched.alias("enriched"))


@query(r"""WITH t AS (SELECT p_partkey, '[' || p_brand || '] [TABLE, page 3, ' || CAST(p_size AS VARCHAR) || ' rows × 4 cols]' || CASE WHEN p_partkey % 2 = 0 THEN ' [Caption: ' || p_type || ']' ELSE '' END AS p, CASE WHEN p_partkey % 2 = 0 THEN p_type || chr(10) ELSE '' END AS c, p_name,
'This table is from the paper ''' || p_brand || '''. ' || CASE WHEN p_partkey % 2 = 0 THEN 'It presents: ' || p_type || '. ' ELSE '' END || 'The table contains ' || CAST(p_size AS VARCHAR) || ' data rows across 4 columns.' AS about FROM part) SELECT p_partkey, p || chr(10) || c || p_name AS display, p || chr(10) || about || chr(10) || p_name AS enriched FROM t""")
def k05_table_chunks(spark, d):
    caption = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise("")
    display, enriched = extraction.table_chunk(F.col("p_brand"), F.lit(3), F.col("p_size"), F.lit(4), caption, F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", display.alias("display"), enriched.alias("enriched"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(lower(k), 'table|tabular|spreadsheet|grid') THEN 'table' WHEN regexp_matches(lower(k), 'equation|formula|mathematical|math expression') THEN 'formula' ELSE 'figure' END AS route FROM (SELECT p_partkey, ['Table of ', 'GRID ', 'an Equation ', 'plot '][p_partkey % 4 + 1] || p_type AS k FROM part)")
def k08_route_vision(spark, d):
    heads = F.array(*[F.lit(x) for x in ("Table of ", "GRID ", "an Equation ", "plot ")])
    return table(spark, d, "part").select("p_partkey", extraction.route_vision(F.concat(F.get(heads, (F.col("p_partkey") % 4).cast("int")), "p_type")).alias("route"))


#: What stands around a chunk's text: bracketed metadata, captions, descriptions, rows.
SHOWN_EDGES = [
    ("[Title] [Caption: **Cap** of it] ", "\n|---|\n | h | i |\n| 1 | 2 |"), ("", ""), ("This table is from the paper 'A b'. It presents: x. ", "\nmore"), ("[Caption:  ]", ""), ("Figure 3 shows ", "\nno"), ("## head\n", "\n\n## x\nlast"), ("[only metadata]", ""),
]


def _shown_sql() -> str:
    e, n = extraction, len(SHOWN_EDGES)
    strip = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    lines = lambda c: f"list_transform(string_split({c}, chr(10)), lambda x: {strip('x')})"
    header = f"list_filter({lines('t2')}, lambda x: starts_with(x, '|') AND NOT regexp_matches(x, '{e.RULE_ROW}'))[1]"
    return f"""WITH {fx.CHUNKS_SQL}, raw AS (SELECT paragraph_id, chunk_type, {_sql_list([a for a, _ in SHOWN_EDGES])}[ord % {n} + 1] || CASE WHEN ord % {n} IN (3, 6) THEN '' ELSE text END || {_sql_list([b for _, b in SHOWN_EDGES])}[ord % {n} + 1] || ' [ab_P1]' AS x FROM chunks),
c AS (SELECT *, {strip("regexp_replace(x, '" + e.CITATION + "', '', 'g')")} AS c FROM raw),
s AS (SELECT *, {strip("regexp_extract(c, '" + e.CAPTION + "', 1)")} AS caption, {strip("regexp_replace(c, '" + e.METADATA + "', '')")} AS t FROM c), s2 AS (SELECT *, {strip("regexp_replace(t, '" + e.DESCRIPTION.replace("'", "''") + "', '', 'g')")} AS t2 FROM s),
r AS (SELECT paragraph_id, c, CASE chunk_type WHEN 'text' THEN c WHEN 'table' THEN CASE WHEN caption <> '' THEN caption || coalesce(chr(10) || {header}, '') ELSE {lines("t2")}[1] END
WHEN 'figure' THEN CASE WHEN caption <> '' THEN regexp_replace(caption, '\\*{{1,3}}(.+?)\\*{{1,3}}', '\\1', 'g') WHEN regexp_matches({lines("t")}[1], 'Figure|Fig\\.') THEN {lines("t")}[1] ELSE 'Figure/Image Content' END
ELSE array_to_string(list_filter({lines("t")}, lambda x: x <> '' AND NOT starts_with(x, '##'))[1:2], ' ') END AS r FROM s2)
SELECT paragraph_id, CASE WHEN r = '' THEN c WHEN length(r) > 300 THEN regexp_replace(substr(r, 1, 300), '\\s+$', '') || '...' ELSE r END AS shown FROM r"""


@query(_shown_sql())
def f13_display_source(spark, d):
    k, n = (F.col("ord") % len(SHOWN_EDGES)).cast("int"), len(SHOWN_EDGES)
    edge = lambda i: F.get(F.array(*[F.lit(x[i]) for x in SHOWN_EDGES]), k)
    text = F.concat(edge(0), F.when(F.col("ord") % n == 3, "").when(F.col("ord") % n == 6, "").otherwise(F.col("text")), edge(1), F.lit(" [ab_P1]"))
    return fx.chunks(spark, d).select("paragraph_id", extraction.display_source(text, F.col("chunk_type")).alias("shown"))


# Answers


@query("SELECT conv_id, turn, (contains(t, 'i cannot') OR contains(t, 'no information') OR contains(t, 'not available')) AS abstains FROM (SELECT conv_id, turn, lower(CASE turn % 5 WHEN 1 THEN 'I cannot say. ' || text WHEN 2 THEN text || ' There is No Information' ELSE text END) AS t FROM conversations)")
def a09_abstentions(spark, d):
    text = F.when(F.col("turn") % 5 == 1, F.concat(F.lit("I cannot say. "), "text")).when(F.col("turn") % 5 == 2, F.concat("text", F.lit(" There is No Information"))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", answers.is_abstention(text).alias("abstains"))


@query(rf"""WITH {fx.ANSWERS_SQL}, s AS (SELECT answer_id, unnest(string_split(x, chr(1))) AS s, generate_subscripts(string_split(x, chr(1)), 1) AS n FROM (SELECT answer_id, regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g') AS x FROM answers)),
g AS (SELECT *, sum(st) OVER (PARTITION BY answer_id ORDER BY n) AS place FROM (SELECT *, (NOT regexp_matches(s, '^(?i)\s*\[(?:[a-z0-9\-_]+_)?[PFTE]\d+\]') OR row_number() OVER (PARTITION BY answer_id ORDER BY n) = 1)::INT AS st FROM s WHERE trim(s) <> '')),
t AS (SELECT answer_id, place, string_agg(s, ' ' ORDER BY n) AS text FROM g GROUP BY 1, 2), r AS (SELECT *, list_distinct(list_transform(regexp_extract_all(text, '{answers.REF}', 1), lambda x: upper(x))) AS refs FROM t),
h AS (SELECT answer_id, paragraph_id, string_split(paragraph_id, '_')[2] AS ref, (answer_id * 37 + length(paragraph_id)) % 100 / 100.0::DOUBLE AS score FROM valid WHERE answer_id % 3 > 0),
b AS (SELECT r.answer_id, place, max(score) AS score, string_agg(DISTINCT ref || '=' || paragraph_id, ',' ORDER BY ref || '=' || paragraph_id) AS items FROM r JOIN h ON h.answer_id = r.answer_id AND list_contains(refs, ref) GROUP BY 1, 2)
SELECT r.answer_id, r.place::BIGINT AS place, text, array_to_string(list_sort(refs), ',') AS refs, score, CASE WHEN score IS NOT NULL THEN {fx.CONFIDENCE_SQL.format("score")} END AS level, items FROM r LEFT JOIN b ON b.answer_id = r.answer_id AND b.place = r.place""")
def a10_cited_sentences(spark, d):
    said, valid = fx.answers(spark, d)
    score = (F.col("answer_id") * 37 + F.length("paragraph_id")) % 100 / F.lit(100.0)
    results = valid.where("answer_id % 3 > 0").select("answer_id", "paragraph_id", F.substring_index("paragraph_id", "_", -1).alias("ref"), score.alias("score"), F.col("paragraph_id").alias("ord"))
    pairs = F.array_join(F.array_sort(F.transform("items", lambda i: F.concat(i["ref"], F.lit("="), i["paragraph_id"]))), ",")
    return answers.cited_sentences(said, results).withColumns({"refs": F.array_join(F.array_sort("refs"), ","), "items": pairs})


@query(f"WITH {fx.RESULTS_SQL} SELECT answer_id, claim_idx, CASE WHEN score < 0.4 THEN 'unsupported' WHEN string_similarity > 0.75 AND score > 0.8 THEN 'direct_quote' WHEN claim = 'both papers differ' THEN 'synthesis' WHEN score > 0.7 THEN 'paraphrase' WHEN score > 0.4 AND score < 0.7 AND cross_encoder > 0.5 THEN 'inference' ELSE 'uncertain' END AS attribution FROM results")
def a06_classify_chat(spark, d):
    r = fx.results(spark, d).withColumns({"semantic": F.col("score"), "is_dominant": F.lit(True), "n_sources": F.lit(5)})
    return verification.classify_attribution(r).select("answer_id", "claim_idx", "attribution")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 'Not mentioned' ELSE o_orderpriority END AS problem, CASE WHEN o_orderkey % 3 = 0 THEN 'm' ELSE 'Not mentioned' END AS method FROM orders""")
def c07_parse_contributions(spark, d):
    k = F.col("o_orderkey") % 3
    one = F.concat(F.lit('```json\n{"problem": {"text": "'), "o_orderpriority", F.lit('", "paragraph_id": "P1"}, "method": "m"}\n```'))
    two = F.concat(F.lit('Sure: {"problem": "'), "o_orderpriority", F.lit('"} done'))
    parsed = answers.parse_contributions(F.when(k == 0, one).when(k == 1, two).otherwise("no json"))
    return table(spark, d, "orders").select("o_orderkey", parsed.alias("c")).select("o_orderkey", "c.problem", "c.method")


def _papers(spark, d):
    """Model output with two papers, with one object of a paper, and without JSON."""
    k, n = F.col("p_partkey"), F.col("p_partkey") % 3
    row = F.struct(F.when(k % 4 == 0, "N/A").otherwise(F.col("p_type")).alias("model"), F.when(k % 8 == 0, " ").otherwise("v").alias("value"), F.when(k % 10 == 0, "").otherwise(F.col("p_brand")).alias("dataset"))
    paper = F.concat(F.lit('{"task": "t", "datasets": "d", "metrics": ["f1", "auc"], "results": ['), F.to_json(row), F.lit(', {"model": "m2", "value": '), F.col("p_size").cast("string"), F.lit("}]}"))
    text = F.when(n == 0, F.concat(F.lit("```json\n["), paper, F.lit(', {"datasets": ["d", "e"], "metrics": "f1", "results": "none"}]\n```'))).when(n == 1, F.concat(F.lit("Found: "), paper, F.lit(" end"))).otherwise("no json {here")
    return answers.extracted_papers(table(spark, d, "part").select(k.alias("answer_id"), text.alias("text")))


@query("""WITH e AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN 'Unknown' ELSE p_brand END AS dataset, CASE WHEN p_partkey % 4 = 0 THEN 'N/A' ELSE p_type END AS model FROM part WHERE p_partkey % 3 < 2 AND p_partkey % 8 > 0 UNION ALL SELECT 'Unknown', 'm2' FROM part WHERE p_partkey % 3 < 2)
SELECT dataset, count(*) AS n_results, count(DISTINCT model) AS n_models FROM e GROUP BY 1""")
def c09_evaluation_results(spark, d):
    return answers.results_by_dataset(answers.evaluation_results(_papers(spark, d)))


@query("""SELECT p_partkey AS answer_id, n AS paper, CASE n WHEN 0 THEN 'f1,auc' ELSE 'f1' END AS metrics, CASE n WHEN 0 THEN 'd' ELSE 'd,e' END AS datasets FROM part, (VALUES (0), (1)) AS a(n) WHERE p_partkey % 3 + n < 2 AND (n = 0 OR p_partkey % 3 = 0)""")
def c09_paper_benchmarks(spark, d):
    return answers.paper_benchmarks(_papers(spark, d)).withColumns({"metrics": F.array_join("metrics", ","), "datasets": F.array_join("datasets", ",")})


@query('WITH f AS (SELECT l_orderkey AS comparison_id, l_suppkey AS paper_id, min(l_linenumber) AS ord FROM lineitem GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY comparison_id ORDER BY ord, paper_id) AS "column" FROM f')
def c06_comparison_columns(spark, d):
    return answers.comparison_columns(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("comparison_id"), F.col("l_suppkey").alias("paper_id"), F.col("l_linenumber").alias("ord")))


@query("""WITH r AS (SELECT l_orderkey AS answer_id, l_linenumber % 3 AS paper, l_linenumber * 10000000 + l_partkey AS ord, l_returnflag || l_linestatus AS model, CAST(l_suppkey AS VARCHAR) AS value FROM lineitem), p AS (SELECT DISTINCT answer_id, paper FROM r),
n AS (SELECT answer_id, count(*) AS n FROM p GROUP BY 1 HAVING count(*) > 1), c AS (SELECT n.answer_id, m, x FROM n JOIN p USING (answer_id), (VALUES (3), (5)) AS a(m), (VALUES (1), (2)) AS b(x) WHERE (p.answer_id + p.paper * x) % m > 0 GROUP BY n.answer_id, m, x, n.n HAVING count(*) = n.n),
ok AS (SELECT answer_id FROM c GROUP BY 1 HAVING count(DISTINCT m) = 2), f AS (SELECT answer_id, model, paper, arg_min(value, struct_pack(o := ord, v := value)) AS value, min(ord) AS ord FROM r GROUP BY 1, 2, 3),
s AS (SELECT answer_id, model, row_number() OVER (PARTITION BY answer_id ORDER BY min(paper * 1000000000000 + ord), model) AS place FROM f GROUP BY 1, 2)
SELECT s.answer_id, place, s.model, p.paper, coalesce(f.value, 'N/A') AS value FROM s JOIN ok USING (answer_id) JOIN p USING (answer_id) LEFT JOIN f ON f.answer_id = s.answer_id AND f.model = s.model AND f.paper = p.paper""")
def c10_cross_paper_results(spark, d):
    paper = F.col("l_linenumber") % 3
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("answer_id"), paper.alias("paper"), (F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("ord"), F.concat("l_returnflag", "l_linestatus").alias("model"), F.col("l_suppkey").cast("string").alias("value"))
    some = lambda m: F.filter(F.array(F.lit("1"), F.lit("2")), lambda x: (F.col("answer_id") + F.col("paper") * x.cast("int")) % m > 0)
    return answers.cross_paper_results(rows, rows.select("answer_id", "paper").distinct().withColumns({"metrics": some(3), "datasets": some(5)}))


@query(r"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text ELSE replace(text, ' ', chr(10) || ' - ') || chr(10) || '--' END AS text FROM conversations),
q AS (SELECT conv_id, turn, list_filter(list_transform(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: starts_with(x, '-')), lambda x: regexp_replace(regexp_replace(x, '^-+', ''), '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1:4] AS q FROM t)
SELECT conv_id, turn, array_to_string(CASE WHEN len(q) > 0 THEN q ELSE """ + _sql_list(answers.DEFAULT_QUESTIONS) + r""" END, '|') AS questions FROM q""")
def c11_parse_questions(spark, d):
    """Words as lines with a dash in two of three turns; the third has the default questions."""
    raw = F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(F.concat(F.replace("text", F.lit(" "), F.lit("\n - ")), F.lit("\n--")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(answers.parse_questions(raw), "|").alias("questions"))


def _formula_line_sql() -> str:
    slashes = "length(regexp_replace(c, '[^\\\\]', '', 'g'))"
    # Words of letters of any script, as the query's word boundary has it; that of RE2 knows ASCII only and finds words inside them.
    long = lambda n: f"len(list_filter(regexp_extract_all(c, '[\\p{{L}}\\p{{Mn}}\\p{{Nd}}_]+'), lambda w: regexp_full_match(w, '[A-Za-z]{{{n},}}')))"
    valid = (
        f"NOT (c = '' OR contains(c, '##') OR ends_with(c, ':') OR (length(c) > 220 AND NOT contains(c, '=') AND {slashes} = 0)) AND (regexp_matches(c, '{answers.DELIMITED}') OR contains(c, '=') OR ({slashes} >= 2 AND {long(3)} <= 6)"
        f" OR (length(regexp_replace(c, '[^=<>^_{{}}()\\[\\]+\\-/*]', '', 'g')) >= 4 AND {long(3)} <= 4 AND length(c) <= 120))"
    )
    score = f"CASE WHEN regexp_matches(c, '{answers.SIGNAL}') THEN 5 ELSE 0 END + 2 * {slashes} + length(regexp_replace(c, '[^=<>^_{{}}()\\[\\]]', '', 'g')) - CASE WHEN {long(4)} > 5 AND NOT contains(c, '=') THEN 4 ELSE 0 END"
    return f"""WITH {FORMULA_SQL}, l AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') AS c, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM fdocs), s AS (SELECT *, {score} AS score FROM l),
t AS (SELECT doc_id, 3 AS tier, arg_max(c, score * 1000000 - i) AS c FROM s WHERE score > 0 GROUP BY 1 UNION ALL SELECT doc_id, 2, regexp_replace(regexp_extract(text, '{answers.DELIMITED}', 1), '^\\s+|\\s+$', '', 'g') FROM fdocs UNION ALL SELECT doc_id, 1, CASE doc_id % 5 WHEN 0 THEN '$x$' WHEN 1 THEN 'a = b:' ELSE '' END FROM fdocs),
v AS (SELECT doc_id, arg_min(c, tier) AS line FROM t WHERE {valid} GROUP BY 1) SELECT f.doc_id, coalesce(line, '') AS line FROM fdocs f LEFT JOIN v ON v.doc_id = f.doc_id"""


@query(_formula_line_sql())
def m05_best_formula_line(spark, d):
    given = F.when(F.col("doc_id") % 5 == 0, " $x$").when(F.col("doc_id") % 5 == 1, "a = b:")
    return _fdocs(spark, d).select("doc_id", answers.best_formula_line(given, F.col("text")).alias("line"))


@query("WITH a AS (SELECT l_returnflag AS title, 'P' || CAST(l_suppkey % 9 AS VARCHAR) AS asset_id, l_returnflag || l_linestatus AS kind, l_linestatus AS text, l_orderkey * 10 + l_linenumber AS ord FROM lineitem) SELECT title, asset_id, kind, substr(sha256(asset_id || '|' || kind || '|' || text), 1, 12) AS digest, min(ord) AS ord FROM a GROUP BY 1, 2, 3, 4")
def m09_dedup_assets(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("title"), F.concat(F.lit("P"), (F.col("l_suppkey") % 9).cast("string")).alias("asset_id"), F.concat("l_returnflag", "l_linestatus").alias("kind"), F.col("l_linestatus").alias("text"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return answers.dedup_assets(a)


@query(rf"""WITH {fx.CHUNKS_SQL}, j AS (SELECT paper_id AS doc_id, substr(string_agg(text, ' ' ORDER BY ord % 4 <> 1, ord), 1, 15000) AS t FROM chunks GROUP BY paper_id)
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), 'https?://\S+|www\.\S+', ' ', 'g'), '\S+@\S+\.\S+', ' ', 'g'), '[#*_`|]', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM j""")
def n01_keyword_text(spark, d):
    c = fx.chunks(spark, d).select(F.col("paper_id").alias("doc_id"), "ord", "text", (F.col("ord") % 4 == 1).alias("is_priority"))
    return answers.keyword_text(c)


@query("WITH k AS (SELECT p_type AS keyword, p_retailprice::DOUBLE AS score, p_partkey AS ord FROM part), g AS (SELECT lower(keyword) AS k, round(avg(score), 6) AS score, arg_min(keyword, ord) AS keyword, count(*) AS papers FROM k GROUP BY 1) SELECT * FROM g ORDER BY score DESC, k LIMIT 40")
def n03_library_keywords(spark, d):
    return answers.library_keywords(table(spark, d, "part").select(F.col("p_type").alias("keyword"), F.col("p_retailprice").cast("double").alias("score"), F.col("p_partkey").alias("ord")))


@query("""WITH s AS (SELECT l_orderkey AS answer_id, l_linenumber * 10000000 + l_partkey AS ord, 'P' || CAST(l_suppkey % 5 AS VARCHAR) AS paragraph_id, 'S' || CAST(l_partkey AS VARCHAR) AS text FROM lineitem), c AS (SELECT o_orderkey AS answer_id, 0 AS claim_idx, 'P' || CAST(o_orderkey % 5 AS VARCHAR) AS cited FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY ord, text) AS n FROM s), p AS (SELECT c.answer_id, claim_idx, text FROM c JOIN f USING (answer_id) WHERE n <= 3 UNION SELECT c.answer_id, claim_idx, arg_max(s.text, s.ord) FROM c JOIN s ON s.answer_id = c.answer_id AND s.paragraph_id = c.cited GROUP BY 1, 2) SELECT DISTINCT * FROM p""")
def v05_rerank_candidates(spark, d):
    s = lambda c: c.cast("string")
    sources = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("answer_id"), (F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("ord"), F.concat(F.lit("P"), s(F.col("l_suppkey") % 5)).alias("paragraph_id"), F.concat(F.lit("S"), s(F.col("l_partkey"))).alias("text"))
    claims = table(spark, d, "orders").select(F.col("o_orderkey").alias("answer_id"), F.lit(0).alias("claim_idx"), F.lit(True).alias("needs_rerank"), F.concat(F.lit("see [P"), s(F.col("o_orderkey") % 5), F.lit("]")).alias("claim"))
    return verification.rerank_candidates(claims, sources, k=1)


@query("""WITH p AS (SELECT event_id, user_id AS paper_id, user_id % 20 AS batch_id, ts, CASE event_id % 4 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'Completed' WHEN 2 THEN 'completed' ELSE 'queued' END AS status FROM events WHERE user_id % 9 > 0),
b AS (SELECT DISTINCT user_id % 20 AS batch_id, user_id AS paper_id, min(ts) OVER (PARTITION BY user_id % 20) + INTERVAL 1 DAY * (user_id % 20) AS started FROM events),
l AS (SELECT p.batch_id, p.paper_id, arg_max(lower(status), struct_pack(t := ts, e := event_id)) AS s FROM p JOIN b ON b.batch_id = p.batch_id AND b.paper_id = p.paper_id WHERE epoch_us(ts) <= epoch_us(started) + 660000000 GROUP BY 1, 2),
c AS (SELECT b.batch_id, count(*) AS total, count(*) FILTER (WHERE s = 'completed') AS n, bool_and(coalesce(s, 'failed') IN ('completed', 'failed')) AS done FROM b LEFT JOIN l ON l.batch_id = b.batch_id AND l.paper_id = b.paper_id GROUP BY 1)
SELECT batch_id, total, CASE WHEN done THEN n ELSE 0 END AS completed, CASE WHEN done THEN total - n ELSE 0 END AS failed, done, NOT done AS timed_out FROM c""")
def e04_batch_complete(spark, d):
    """Batches start a day apart, so that some end before their time is up."""
    status = F.get(F.array(*[F.lit(x) for x in ("FAILED", "Completed", "completed", "queued")]), (F.col("event_id") % 4).cast("int"))
    all_events, batch = table(spark, d, "events"), F.col("user_id") % 20
    first = all_events.groupBy(batch.alias("batch_id")).agg((F.min("ts") + F.make_dt_interval(F.first(batch).cast("int"))).alias("started"))
    batches = all_events.select(batch.alias("batch_id"), F.col("user_id").alias("paper_id")).distinct().join(first, "batch_id")
    events = all_events.where("user_id % 9 > 0").select("event_id", F.col("user_id").alias("paper_id"), batch.alias("batch_id"), "ts", status.alias("status"))
    return library.batch_complete(events, batches)


@query("SELECT conv_id, max(turn) AS last_turn, row_number() OVER (ORDER BY max(turn) DESC, conv_id) AS place FROM conversations GROUP BY conv_id")
def q03_sessions_recent(spark, d):
    """Place of each session by last use; counted by turn first, so no task sorts all sessions."""
    return library.sessions_recent(table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn")), "conv_id", "last_turn")
