"""Pages, paragraphs, sentences and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.text import let, paragraph_type, token_count

# Abbreviations after which a sentence goes on.
ABBREVIATIONS = (
    "et al|Fig|fig|Figs|figs|Eq|eq|Eqs|eqs|cf|viz|nb|e\\.g|i\\.e|vs|i\\.e\\.?|e\\.g\\.?|et seq|op cit|ibid|Dr|Mr|Mrs|Ms|Prof|Jr|Sr|Rev|Gen|Sgt|Cpl|Lt|Col|Maj|St|"
    "Inc|Ltd|Corp|Dept|Assoc|Univ|Inst|Vol|No|pp|Ch|Sec|Sect|approx|est|avg|max|min|Tab|Tbl|Ref|Refs|Suppl|Supp|App|etc|vs\\.?"
)
TARGET_TOKENS, MAX_TOKENS = 400, 800


def page_offsets(pages: DataFrame) -> DataFrame:
    """Adds ``start``: where a page begins in the document text of pages joined by two line feeds."""
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("start", F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)).cast("long"))


def page_of_offset(positions: DataFrame, offsets: DataFrame) -> DataFrame:
    """As-of: the page with the greatest start at or below each position, the first page below that. One sort of both sides, no range join."""
    marks = offsets.select("doc_id", F.col("start").alias("offset"), F.lit(0).alias("is_position"), F.col("page").alias("found"), F.lit(None).cast("long").alias("pos_id"))
    asked = positions.select("doc_id", "offset", F.lit(1).alias("is_position"), F.lit(None).cast("int").alias("found"), F.col("pos_id").cast("long"))
    w = Window.partitionBy("doc_id").orderBy("offset", "is_position")
    first = F.min("found").over(Window.partitionBy("doc_id"))
    both = marks.unionByName(asked).withColumn("page", F.coalesce(F.last("found", ignorenulls=True).over(w), first))
    return both.where("is_position = 1").select("doc_id", "pos_id", "offset", "page")


def split_paragraphs(docs: DataFrame, *, separator: str = r"\n\s*\n", min_chars: int = 20) -> DataFrame:
    """doc_id, para (place among the pieces), text: pieces of at least ``min_chars`` characters after trimming."""
    pieces = docs.select("doc_id", F.posexplode(F.split("text", separator)).alias("para", "text"))
    return pieces.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).where(F.length("text") >= min_chars)


def raw_sentences(text: Column) -> Column:
    """Fragments at white space after . ! ? and before a capital or a quotation mark."""
    return F.split(text, r'(?<=[.!?])\s+(?=[A-Z"])')


#: Stands for a sentence end while fragments are joined; no text has it.
END = "\x01"

#: Sentence ends that are none: after an abbreviation, looked for back from the mark, so that nothing is tried at other places, and after the number of a figure; as (pattern, replacement).
JOINED = [(rf"{END}(?<=(?:^|[^\p{{L}}\p{{N}}_])(?i:{ABBREVIATIONS})\.{END})", " "), (rf"(?i)((?:Figure|Table|Equation)\s+\d+\.){END}", "$1 ")]

#: A citation ends a sentence only if that has so many words.
CITED_WORDS = 4


def _cited(pieces: Column) -> Column:
    """Pieces that end in a citation joined to the next while the joined text has fewer than ``CITED_WORDS`` words; its words count from the last end that stands."""
    words = lambda s: F.size(F.array_remove(F.split(s, r"\s+"), ""))
    sized = F.transform(pieces, lambda s: F.struct(s.alias("text"), words(s).alias("n"), s.rlike(r"\]\.\s*$").alias("cited")))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        text = F.when(acc["open"] == "", s["text"]).otherwise(F.concat(acc["open"], F.lit(" "), s["text"]))
        goes_on = s["cited"] & (acc["n"] + s["n"] < CITED_WORDS)
        return F.struct(F.when(goes_on, acc["out"]).otherwise(F.array_append(acc["out"], text)).alias("out"), F.when(goes_on, text).otherwise("").alias("open"), F.when(goes_on, acc["n"] + s["n"]).otherwise(0).alias("n"))

    return F.aggregate(sized, start, step, lambda acc: F.when(acc["open"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["open"])))


def sentences(text: Column) -> Column:
    """Fragments, those after an abbreviation or the like joined to the next by a blank.

    Abbreviations are found by passes over the marked text, as they show at the end of a fragment; a short text that ends in a citation depends on what was joined before, so only texts with such an end are folded.
    """
    marked = F.regexp_replace(F.replace(text, F.lit(END), F.lit(" ")), r'([.!?])\s+(?=[A-Z"])', f"$1{END}")
    for pattern, to in JOINED:
        marked = F.regexp_replace(marked, pattern, to)

    def split(joined: Column) -> Column:
        return F.when(joined.contains(f"].{END}"), _cited(F.split(joined, END))).otherwise(F.split(joined, END))

    return F.filter(F.transform(let(marked, split), lambda s: F.trim(s)), lambda s: s != "")


def sentence_map(text: Column, paragraph_id: Column) -> Column:
    """Ordered array of struct(key, text, start, end, tokens); a text without sentences is one sentence."""
    kind = "array<struct<key:string,text:string,start:int,end:int,tokens:long>>"
    start = F.struct(F.array().cast(kind).alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        found_at = F.call_function("locate", s, text, acc["at"] + 1)
        begin = F.when(found_at > 0, found_at - 1).otherwise(acc["at"])
        key = F.concat(paragraph_id, F.lit("_S"), F.size(acc["out"]).cast("string"))
        item = F.struct(key.alias("key"), s.alias("text"), begin.alias("start"), (begin + F.length(s)).alias("end"), token_count(s).alias("tokens"))
        return F.struct(F.array_append(acc["out"], item).alias("out"), (begin + F.length(s)).alias("at"))

    mapped = lambda found: F.aggregate(F.when(F.size(found) == 0, F.array(text)).otherwise(found), start, step, lambda acc: acc["out"])
    return let(sentences(text), mapped)


def pack_sentences(paragraphs: DataFrame, *, target: int = TARGET_TOKENS, most: int = MAX_TOKENS) -> DataFrame:
    """doc_id, para, sub, text, tokens: paragraphs of up to ``most`` tokens stay whole, others are packed greedily from sentences.

    The fold keeps only where chunks start; their texts are cut out afterwards.
    """
    begin = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("tokens"))

    def step(acc: Column, s: Column) -> Column:
        full = (acc["at"] == 0) | (acc["tokens"] + s["tokens"] > target)
        starts = F.when(full, F.array_append(acc["starts"], acc["at"])).otherwise(acc["starts"])
        return F.struct(starts.alias("starts"), (acc["at"] + 1).alias("at"), F.when(full, s["tokens"]).otherwise(acc["tokens"] + s["tokens"]).alias("tokens"))

    def packed(found: Column) -> Column:
        def chunk(starts: Column, start: Column, k: Column) -> Column:
            own = F.slice(found, start + 1, F.coalesce(F.get(starts, k + 1), F.size(found)) - start)
            tokens = F.aggregate(own, F.lit(0).cast("long"), lambda n, s: n + s["tokens"])
            return F.struct(F.array_join(F.transform(own, lambda s: s["text"]), " ").alias("text"), tokens.alias("tokens"))

        return let(F.aggregate(found, begin, step, lambda acc: acc["starts"]), lambda starts: F.transform(starts, lambda start, k: chunk(starts, start, k)))

    sized = F.transform(sentences(F.col("text")), lambda s: F.struct(s.alias("text"), token_count(s).alias("tokens")))
    whole = lambda n: F.array(F.struct(F.col("text").alias("text"), n.alias("tokens")))
    chunks = let(token_count(F.col("text")), lambda n: F.when(n <= most, whole(n)).otherwise(let(sized, packed)))
    return paragraphs.select("doc_id", "para", F.posexplode(chunks).alias("sub", "chunk")).select("doc_id", "para", "sub", "chunk.text", "chunk.tokens")


def number_chunks(chunks: DataFrame, *order: str) -> DataFrame:
    """Adds ``idx`` and ``paragraph_id`` (first 8 characters of the document id, ``_P``, running number)."""
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1
    return chunks.withColumn("idx", idx).withColumn("paragraph_id", F.concat(F.substring(F.col("doc_id").cast("string"), 1, 8), F.lit("_P"), F.col("idx").cast("string")))


def enrich_chunks(chunks: DataFrame) -> DataFrame:
    """Puts ``[title] [section] `` before the text, and once more before the enriched text; tokens are those of the prefixed text."""
    bracketed = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit("["), F.col(c), F.lit("]")))
    prefix = F.concat_ws(" ", bracketed("title"), bracketed("section"))
    put = lambda t: F.when(prefix == "", t).otherwise(F.concat(prefix, F.lit(" "), t))
    text = put(F.col("text"))
    return chunks.withColumns({"text": text, "enriched_text": put(text), "token_count": token_count(text)})


def assemble_chunks(*typed: DataFrame) -> DataFrame:
    """Union of chunks in the order text, figure, table, formula; all share one counter, the id letter tells the type."""
    letters, out = ("P", "F", "T", "E"), None
    for rank, df in enumerate(typed):
        part = df.select("doc_id", "ord", "text", F.lit(rank).alias("type_rank"), F.lit(letters[rank]).alias("letter"))
        out = part if out is None else out.unionByName(part)
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("type_rank", "ord")) - 1
    out = out.withColumn("idx", idx).withColumn("paragraph_id", F.concat(F.substring(F.col("doc_id").cast("string"), 1, 8), F.lit("_"), F.col("letter"), F.col("idx").cast("string")))
    return out.select("doc_id", "paragraph_id", "text", paragraph_type(F.col("paragraph_id")).alias("chunk_type"))


def section_headers(chunks: DataFrame) -> DataFrame:
    """Rows at which a reader shows a section title: where it differs from that of the chunk before."""
    before = F.lag("section").over(Window.partitionBy("doc_id").orderBy("ord"))
    return chunks.withColumn("shows_header", ~F.col("section").eqNullSafe(before))


def locate_text(spans: DataFrame, docs: DataFrame, *, cascade: str = "section", snippet: int = 200, shortest: int = 50) -> DataFrame:
    """Place of each span in its document: its whole content, else its first ``snippet`` characters, trimmed, if longer than ``shortest``.

    Sections are searched by their title then, chunks by their first sentence if it is longer than 30 characters; chunks under 20 characters are not searched at all.
    """
    joined = spans.join(docs.select("doc_id", F.col("text").alias("document")), "doc_id")
    at = lambda c: F.nullif(F.call_function("locate", c, F.col("document")), F.lit(0))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    head = strip(F.substring("content", 1, snippet))
    found = [F.when(F.col("content") != "", at(F.col("content"))), F.when(F.length(head) > shortest, at(head))]
    if cascade == "section":
        place = F.coalesce(*found, F.when((F.col("title") != "Full Document") & (F.col("title") != ""), at(F.col("title"))))
    else:
        sentence = strip(F.split_part(F.col("content"), F.lit(". "), F.lit(1)))
        place = F.when(F.length("content") >= 20, F.coalesce(*found, F.when(F.length(sentence) > 30, at(sentence))))
    return joined.select("doc_id", "span_id", (place - 1).alias("offset"))


def backfill_pages(chunks: DataFrame) -> DataFrame:
    """Estimated 1-based page of text chunks without one: ``idx * pages div chunks + 1``, at most ``pages``."""
    counted = chunks.withColumn("_n", F.greatest(F.count("*").over(Window.partitionBy("doc_id")), F.lit(1)))
    estimate = F.least(F.expr("(idx * pages) div _n") + 1, F.col("pages").cast("long"))
    return counted.withColumn("page", F.coalesce(F.col("page").cast("long"), F.when(F.col("paragraph_id").contains("_P"), estimate))).drop("_n")
