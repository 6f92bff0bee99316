"""SQL twins (DuckDB) of the queries that SQL can express; the others are held against brute force in tests/llm."""

from __future__ import annotations

from docspark.llm import quality_rules, vector_codes
from docspark.llm.common import UPPER
from docspark.llm.license_scan import BASE, NOT_WORD, WORDINGS
from docspark.llm.url_filter import MARKS, RULES


def _op1() -> str:
    def places(text: str) -> str:
        ws = text.split()
        return "list_filter(generate_series(1, len(ws)), lambda i: " + " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(ws)) + ")"

    # A long wording that is not whole has no SQL form; the SQL looks for whole ones.
    wordings = ", ".join(f"CASE WHEN contains(joined, ' {t.text} ') THEN '{t.label}' END" for t in WORDINGS)
    base = ", ".join(f"CASE WHEN len({t.label}_at) > 0 THEN '{t.label}' END" for t in BASE)
    listed = lambda x: f"coalesce(array_to_string(list_sort(list_distinct(list_filter({x}, lambda v: v IS NOT NULL))), ','), '')"
    every = "list_concat(" + ", ".join(f"{t.label}_at" for t in BASE[:2]) + f"), {BASE[2].label}_at"
    return f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{NOT_WORD}'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS n_words, ' ' || array_to_string(ws, ' ') || ' ' AS joined, {", ".join(f"{places(t.text)} AS {t.label}_at" for t in BASE)} FROM w),
q AS (SELECT *, list_concat({every}) AS places, [{base}] AS b, [{wordings}] AS o FROM p)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word, {listed("b")} AS base_labels, {listed("list_concat(b, o)")} AS labels,
CASE WHEN len(list_filter(list_concat(b, o), lambda v: v IS NOT NULL)) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM q"""


def _op8() -> str:
    def chain(column: str) -> str:
        order = sorted(RULES, key=lambda r: (-len(r.name), r.name))
        whens = [f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, column)}'" for r in order]
        return "CASE " + " ".join(whens) + " END"

    return f"""WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{UPPER.lower()}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, regexp_extract(coalesce(html, ''), '(?s)<article\\b[^>]*>(.*)</article>', 1) AS article FROM pages),
j AS (SELECT *, regexp_replace(regexp_replace(host, '\\.?(?::[0-9]*)?$', ''), '^(?:www|m)\\.', '') AS bare, {chain("name")} AS rule, {chain("action")} AS action, regexp_replace(regexp_replace(host, '\\.?(?::[0-9]*)?$', ''), '^(?:www|m)\\.', '') || regexp_replace(regexp_replace(path, '/{{2,}}', '/', 'g'), '(?:/index\\.html?|\\.html?|/)$', '') AS canonical, regexp_matches(host, '(?:^|[.-])(?:{"|".join(MARKS)})(?:$|[.-])') AS marked FROM u),
f AS (SELECT article, arg_min(bare, page_id) AS first FROM j WHERE article <> '' AND host <> '' GROUP BY article), listed AS (SELECT canonical FROM j WHERE marked UNION SELECT canonical FROM j JOIN f USING (article) WHERE host <> '' AND bare <> first)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN host <> '' AND canonical IN (FROM listed) THEN 'block' ELSE 'allow' END) AS verdict FROM j"""


OP9 = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
w AS (SELECT doc_id, pos, line || chr(10) || lead(line, 1) OVER d || chr(10) || lead(line, 2) OVER d AS joint FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
v AS (SELECT * FROM w WHERE joint IS NOT NULL AND regexp_matches(joint, '\S')),
f AS (SELECT *, row_number() OVER (PARTITION BY joint ORDER BY doc_id, pos) AS n FROM v),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM f, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) AS text FROM l ANTI JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id),
c AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN c.n IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text, coalesce(len(string_split(d.text, chr(10))), 0) AS lines_before, coalesce(c.n, 0) AS lines_removed FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN c USING (doc_id)"""

def _op11() -> str:
    parts, entries, rounds = vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS
    apart = "list_sum(list_transform(generate_series(1, len(p.y)), lambda i: (p.y[i] - b.y[i]) * (p.y[i] - b.y[i])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS MATERIALIZED (SELECT p.id, p.part, b.entry, {apart}::BIGINT AS d FROM p JOIN b{r} b USING (part)),
a{r} AS MATERIALIZED (SELECT id, part, min(struct_pack(d := d, entry := entry)) AS best FROM d{r} GROUP BY id, part)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT part, best.entry AS entry, unnest(p.y) AS v, generate_subscripts(p.y, 1) AS i FROM a{r} JOIN p USING (id, part)),
m{r} AS (SELECT part, entry, list(m ORDER BY i) AS y FROM (SELECT part, entry, i, floor(sum(v)::DOUBLE / count(*))::BIGINT AS m FROM s{r} GROUP BY part, entry, i) GROUP BY part, entry),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.y, b.y) AS y FROM b{r} b LEFT JOIN m{r} m ON m.part = b.part AND m.entry = b.entry)""")
    return f"""WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, vec_id, label, list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT id, part, x[part * len(x) // {parts} + 1 : (part + 1) * len(x) // {parts}] AS y FROM v, (SELECT unnest(generate_series(0, {parts - 1})) AS part)),
b0 AS (SELECT part, id AS entry, y FROM p WHERE id < {entries}),
{",".join(steps)},
books AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(y) AS v, generate_subscripts(y, 1) AS i FROM b{rounds})),
coded AS (SELECT id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN v USING (id), books"""


def _op12() -> str:
    q, word = quality_rules, r"[^\x20\x09-\x0D]+"
    text = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    count = lambda pattern: f"len(regexp_extract_all(line, {text(pattern)}))"
    phrases = " OR ".join(f"contains(lower(line), '{p}')" for p in q.BOILERPLATE)
    rule = f"""CASE WHEN words = 0 THEN NULL WHEN words <= 20 AND ({phrases}) THEN 'boilerplate'
WHEN (bars >= 2 AND words <= 4 * (bars + 1)) OR (words <= 4 AND regexp_matches(lower(line), {text(q.MENU_LINE)}) AND NOT ends) THEN 'navigation' WHEN 2 * marked > words OR (words >= 4 AND NOT ends) THEN 'punctuation' END"""
    white = r"[\x20\x09-\x0D]"
    return f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), {text(white + "+")}), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS windows FROM w),
t AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, joint) AS n FROM (SELECT doc_id, unnest(windows) AS joint, generate_subscripts(windows, 1) AS pos FROM g)),
r AS (SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words FROM t, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, {count(word)} AS words, {count('[' + q.BARS + ']')} AS bars, {count(q.MARKED_WORD)} AS marked, length(regexp_replace(line, {text(white)}, '', 'g')) AS chars, regexp_matches(line, {text(q.SENTENCE_END)}) AS ends FROM l),
j AS (SELECT *, {rule} AS rule FROM c),
s AS (SELECT doc_id, count(*) AS n_lines, count(line) FILTER (words > 0) - count(DISTINCT line) FILTER (words > 0) AS n_dup_lines, {", ".join(f"count(*) FILTER (rule = '{x}') AS {x}_lines" for x in q.RULES)}, coalesce(sum(chars) FILTER (rule IS NOT NULL), 0) AS lost FROM j GROUP BY doc_id),
a AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(text, {text(white)}, '', 'g')) AS word_chars, len(regexp_extract_all(text, '[{q.SYMBOLS}]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < {q.LEAST_WORDS} OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed, coalesce(lost, 0) AS lost, coalesce(n_lines, 0) AS n_lines, {", ".join(f"coalesce({x}_lines, 0) AS {x}_lines" for x in q.RULES)} FROM w LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= {q.MAX_LOST} * word_chars AS kept, n_lines, {", ".join(f"{x}_lines" for x in q.RULES)} FROM a"""


#: The CRC is taken bit by bit, since DuckDB has no function for it: a byte is mixed in, then eight shifts (-1).
OP13 = """WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '') AS k, strlen(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c FROM t),
bits AS (SELECT c, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295::BIGINT) % 9 AS h FROM ids),
r AS (SELECT b.c, t.n, t.k, t.size FROM bits b JOIN t ON t.c = b.c - b.c % 5 AND t.n <= b.h UNION ALL SELECT b.c, b.h + t.n, t.k, t.size FROM bits b JOIN t ON t.c = b.c AND t.n > b.h),
p AS (SELECT ids.c, coalesce(list(k ORDER BY n) FILTER (k IS NOT NULL), []) AS path, coalesce(list(size ORDER BY n) FILTER (k IS NOT NULL), []) AS sizes FROM ids LEFT JOIN r ON r.c = ids.c GROUP BY ids.c),
m AS (SELECT c, len(path) AS turns, unnest(generate_series(0, len(path))) AS d, path, sizes FROM p),
nodes AS (SELECT path[1:d] AS node, d, min(c) AS conv_id, count(*) AS n_convs, CASE WHEN d > 0 THEN (count(*) - 1) * any_value(sizes[d]) ELSE 0 END AS saved, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (turns = d), '')) AS ends_sha256 FROM m GROUP BY path[1:d], d),
kids AS (SELECT node[1:d - 1] AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
full_ AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (node)),
sums AS (SELECT node[1:k] AS node, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(generate_series(0, d)) AS k FROM full_) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256 FROM full_ f JOIN sums s USING (node) LEFT JOIN full_ up ON f.d > 0 AND up.node = f.node[1:f.d - 1]"""

ORACLES: dict[str, str] = {"op1_license_scan": _op1(), "op8_url_filter": _op8(), "op9_line_dedup": OP9, "op11_vector_codes": _op11(), "op12_quality_rules": _op12(), "op13_prefix_trie": OP13}
