"""Answers: cited sentences, abstentions, parsed model output, comparisons, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.text import confidence, let

# Phrases of an answer that declines.
ABSTENTIONS = [
    "i cannot", "i can't", "cannot answer", "not mentioned", "no information", "not found in", "not available in", "unable to find", "not discussed in", "outside the scope", "not available",
    "could not be automatically attributed", "information is not available", "i am sorry but", "do not have information",
]
FIELDS = ["problem", "method", "dataset", "metrics", "results"]
# The questions asked where an answer holds none.
DEFAULT_QUESTIONS = [
    "What are the main findings across my library?",
    "How do the methodologies in these papers compare?",
    "What are the common limitations found in this research?",
]
REF = r"(?i)\[(?:[a-z0-9\-_]+_)?([PFTE]\d+)\]"


def is_abstention(text: Column, scores: Column | None = None, low: float = 0.35) -> Column:
    said = F.exists(F.array(*[F.lit(p) for p in ABSTENTIONS]), lambda p: F.contains(F.lower(text), p))
    return said if scores is None else said | ((F.size(scores) > 0) & F.forall(scores, lambda s: s < low))


def cited_sentences(answers: DataFrame, results: DataFrame) -> DataFrame:
    """answer_id, place, text, refs, score, level, items: sentences, one that starts with a citation joined to the one before; refs distinct and upper-case.

    ``results`` has answer_id, ord, ref, paragraph_id, score.  A sentence has the best score of the results of its refs and the first result of each; without a result all three are null.
    """
    raw = answers.select("answer_id", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("n", "s")).where(F.trim("s") != "")
    w = Window.partitionBy("answer_id").orderBy("n")
    starts = (~F.col("s").rlike(r"^(?i)\s*\[(?:[a-z0-9\-_]+_)?[PFTE]\d+\]") | (F.row_number().over(w) == 1)).cast("int")
    grouped = raw.withColumn("_starts", starts).withColumn("place", F.sum("_starts").over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]), " ")
    out = grouped.groupBy("answer_id", "place").agg(text.alias("text"))
    out = out.withColumn("refs", F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(REF), 1), lambda r: F.upper(r))))
    first = results.groupBy("answer_id", "ref").agg(F.max("score").alias("best"), F.min_by("paragraph_id", "ord").alias("paragraph_id"))
    found = out.select("answer_id", "place", F.posexplode("refs").alias("n", "ref")).join(first, ["answer_id", "ref"])
    found = found.groupBy("answer_id", "place").agg(F.max("best").alias("score"), F.array_sort(F.collect_list(F.struct("n", "ref", "paragraph_id"))).alias("items"))
    return out.join(found, ["answer_id", "place"], "left").withColumn("level", F.when(F.col("score").isNotNull(), confidence(F.col("score"))))


def parse_contributions(raw: Column) -> Column:
    """Struct of the five fields of a JSON answer: text, or "Not mentioned"; code fences and text around the object are cut off."""
    body = F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*", ""), r"\s*```\s*$", "")
    found = F.coalesce(F.nullif(F.regexp_extract(body, r"(?s)\{.*\}", 0), F.lit("")), F.lit("{}"))
    field = lambda name: F.coalesce(F.get_json_object(found, f"$.{name}.text"), F.when(~F.coalesce(F.get_json_object(found, f"$.{name}"), F.lit("{")).rlike(r"^[\{\[]"), F.get_json_object(found, f"$.{name}")), F.lit("Not mentioned"))
    return F.struct(*[field(n).alias(n) for n in FIELDS])


def parse_questions(raw: Column, most: int = 4) -> Column:
    """First questions of lines that start with a dash; the default questions where there are none."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    lines = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), "\n"), strip), lambda x: x.startswith("-"))
    found = F.slice(F.filter(F.transform(lines, lambda x: strip(F.regexp_replace(x, "^-+", ""))), lambda x: x != ""), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(*[F.lit(q) for q in DEFAULT_QUESTIONS]))


def extracted_papers(answers: DataFrame) -> DataFrame:
    """answer_id, paper, fields: the papers of a JSON answer, an array or one object, with each field as text; what stands around the JSON is cut off, and what is no JSON has no rows."""
    body = F.regexp_extract("text", r"(?s)[\[{].*[\]}]", 0)
    array = F.when(body.startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    papers = F.posexplode(F.from_json(array, "array<map<string,string>>"))
    return answers.select("answer_id", papers.alias("paper", "fields")).where("fields is not null")


def evaluation_results(papers: DataFrame) -> DataFrame:
    """answer_id, paper, ord, dataset, model, value of the results of ``extracted_papers``: "Unknown" for an empty dataset; without those whose model and value are both missing, and without results that are no objects."""
    each = papers.select("answer_id", "paper", F.posexplode(F.from_json(F.col("fields")["results"], "array<map<string,string>>")).alias("ord", "r"))
    some = lambda c: ~F.trim(F.coalesce(c, F.lit("N/A"))).isin("N/A", "")
    field = lambda name: F.coalesce(F.col("r")[name], F.lit("N/A"))
    kept = each.where(F.col("r").isNotNull() & (some(F.col("r")["model"]) | some(F.col("r")["value"])))
    dataset = F.coalesce(F.nullif(F.col("r")["dataset"], F.lit("")), F.lit("Unknown"))
    return kept.select("answer_id", "paper", "ord", dataset.alias("dataset"), field("model").alias("model"), field("value").alias("value"))


def paper_benchmarks(papers: DataFrame) -> DataFrame:
    """answer_id, paper, metrics, datasets of ``extracted_papers``; a scalar is a list of one."""
    def listed(name: str) -> Column:
        raw = F.col("fields")[name]
        return F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(F.coalesce(raw, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(raw))

    return papers.select("answer_id", "paper", listed("metrics").alias("metrics"), listed("datasets").alias("datasets"))


def results_by_dataset(results: DataFrame) -> DataFrame:
    """Number of results and of models of each dataset."""
    return results.groupBy("dataset").agg(F.count("*").alias("n_results"), F.count_distinct("model").alias("n_models"))


def comparison_columns(rows: DataFrame) -> DataFrame:
    """Distinct papers of a comparison in order of first appearance."""
    first = rows.groupBy("comparison_id", "paper_id").agg(F.min("ord").alias("ord"))
    return first.withColumn("column", F.row_number().over(Window.partitionBy("comparison_id").orderBy("ord", "paper_id")))


def cross_paper_results(results: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """answer_id, place, model, paper, value: models in the order they are first seen, each with its first value (the least of those at one place) in every paper of its answer, N/A where there is none.

    Only answers of two papers or more that all share a metric and a dataset (``paper_benchmarks``) are compared.
    """
    papers = benchmarks.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("paper", "metrics", "datasets"))).alias("papers")).where(F.size("papers") > 1)
    common = lambda name: F.aggregate("papers", F.get("papers", F.lit(0))[name], lambda a, p: F.array_intersect(a, p[name]))
    comparable = papers.where((F.size(common("metrics")) > 0) & (F.size(common("datasets")) > 0)).select("answer_id", F.transform("papers", lambda p: p["paper"]).alias("papers"))
    each = results.groupBy("answer_id", "model", "paper").agg(F.min_by("value", F.struct("ord", "value")).alias("value"), F.min("ord").alias("ord"))
    models = each.groupBy("answer_id", "model").agg(F.map_from_entries(F.collect_list(F.struct("paper", "value"))).alias("by_paper"), F.min(F.struct("paper", "ord")).alias("seen"))
    placed = models.withColumn("place", F.row_number().over(Window.partitionBy("answer_id").orderBy("seen", "model")))
    joined = placed.join(comparable, "answer_id").select("answer_id", "place", "model", "by_paper", F.explode("papers").alias("paper"))
    return joined.select("answer_id", "place", "model", "paper", F.coalesce(F.try_element_at("by_paper", F.col("paper")), F.lit("N/A")).alias("value"))


# A formula between delimiters, and what a formula is known by.
DELIMITED = r"(\\\[[\s\S]+?\\\]|\\\([\s\S]+?\\\)|\$\$[\s\S]+?\$\$|\$[^$\n]+\$)"
SIGNAL = r"(?:\\[A-Za-z]+|[=<>^_{}]|[∑∏∫∂∇∞≈±÷√∀∃≤≥≠⊗])"


def valid_formula(c: Column) -> Column:
    """No heading, no long prose, and a delimited formula, an equation, two commands or enough signs among few words."""
    slashes, words = F.length(F.regexp_replace(c, r"[^\\]", "")), F.regexp_count(c, F.lit(r"\b[A-Za-z]{3,}\b"))
    signs = F.length(F.regexp_replace(c, r"[^=<>^_{}()\[\]+\-/*]", ""))
    none = (c == "") | F.contains(c, F.lit("##")) | c.endswith(":") | ((F.length(c) > 220) & ~F.contains(c, F.lit("=")) & (slashes == 0))
    return ~none & (c.rlike(DELIMITED) | F.contains(c, F.lit("=")) | ((slashes >= 2) & (words <= 6)) | ((signs >= 4) & (words <= 4) & (F.length(c) <= 120)))


def best_formula_line(existing: Column, text: Column) -> Column:
    """The formula given, else the first delimited one, else the line that looks most like a formula, the first on ties; each only if it is valid, and empty if none is.

    A line has 5 for a sign of formulas, 2 a backslash, 1 a symbol, and 4 off for more than five words without an equals sign.
    """
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")

    def score(line: Column) -> Column:
        wordy = (F.regexp_count(line, F.lit(r"\b[A-Za-z]{4,}\b")) > 5) & ~F.contains(line, F.lit("="))
        symbols = F.length(F.regexp_replace(line, r"[^=<>^_{}()\[\]]", ""))
        return F.when(line.rlike(SIGNAL), 5).otherwise(0) + 2 * F.length(F.regexp_replace(line, r"[^\\]", "")) + symbols - F.when(wordy, 4).otherwise(0)

    scored = F.transform(F.transform(F.split(text, "\n"), strip), lambda line, i: F.struct(score(line).alias("score"), (-i).alias("place"), line.alias("line")))
    best = F.array_max(F.filter(scored, lambda s: s["score"] > 0))["line"]
    tiers = [strip(existing), strip(F.regexp_extract(text, DELIMITED, 1)), best]
    return F.coalesce(*[let(F.coalesce(t, F.lit("")), lambda c: F.when(valid_formula(c), c)) for t in tiers], F.lit(""))


def split_parts(text: Column, most: int) -> Column:
    """Parts of at most ``most`` characters: what fits is one part, a longer text is cut at its last blank before the limit, or at the limit where there is none; an empty text is one empty part."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    piece = rf"(?s)\s*(?:.{{1,{most}}}\z|.{{1,{most - 1}}}(?= )|.{{{most}}})"
    found = F.filter(F.transform(F.regexp_extract_all(strip(text), F.lit(piece), 0), strip), lambda x: x != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))


def dedup_assets(assets: DataFrame) -> DataFrame:
    """First asset by title, id, type and 12 digits of a digest of its content."""
    digest = F.substring(F.sha2(F.concat_ws("|", "asset_id", "kind", "text"), 256), 1, 12)
    return assets.groupBy("title", "asset_id", "kind", digest.alias("digest")).agg(F.min("ord").alias("ord"))


def keyword_text(chunks: DataFrame, most: int = 15_000) -> DataFrame:
    """One text per document: chunks of priority sections first, then the others, cut; then addresses and marks removed."""
    ordered = F.array_sort(F.collect_list(F.struct((~F.col("is_priority")).cast("int").alias("r"), "ord", "text")))
    joined = F.substring(F.array_join(F.transform(ordered, lambda x: x["text"]), " "), 1, most)
    clean = joined
    for pattern in (r"!\[[^\]]*\]\([^)]*\)", r"https?://\S+|www\.\S+", r"\S+@\S+\.\S+", r"[#*_`|]"):
        clean = F.regexp_replace(clean, pattern, " ")
    return chunks.groupBy("doc_id").agg(F.trim(F.regexp_replace(clean, r"\s+", " ")).alias("text"))


def library_keywords(keywords: DataFrame, most: int = 40) -> DataFrame:
    """Mean score and first spelling of each keyword over all papers; a top list of ``most``."""
    merged = keywords.groupBy(F.lower("keyword").alias("k")).agg(F.round(F.avg("score"), 6).alias("score"), F.min_by("keyword", "ord").alias("keyword"), F.count("*").alias("papers"))
    return merged.orderBy(F.desc("score"), "k").limit(most)
