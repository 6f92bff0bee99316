"""From a query to ranked, boosted and budgeted chunks; every operator takes a batch of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.text import CITATION

# The router's patterns and base scores.
PATTERNS = [
    ("comparison", 0.7, r"\b(compar|differ|similar|contrast|versus|vs\.?|between|distinguish|relate)\b"),
    ("summary", 0.7, r"\b(summar|overview|outline|gist|brief|tl;?dr|recap|main points?)\b|\b(describe|explain|what is)\b.*?\b(paper|article|work|document|study|research)\b"),
    ("multi_hop", 0.6, r"\b(which papers?|across|all papers?|each paper|how many papers?|every paper|common|shared|overlap)\b"),
    ("metadata", 0.8, r"\b(who wrote|author|year|published|title of|journal|conference|when was|date|doi|abstract of|affiliat)\b"),
    ("follow_up", 0.5, r"\b(more about|elaborate|expand|tell me more|what about|can you explain|go deeper|clarify|that|this|the same)\b"),
]
PAPER_REFERENCE = r"\bpaper\s*#?\d+\b"
TOP_K = {"simple_qa": 10, "comparison": 20, "summary": 15, "metadata": 0, "multi_hop": 15, "follow_up": 15}
# Words that are no keywords, and variants of keywords.
STOP_WORDS = (
    "what is the exact how many where when which who whom this that these those am are was were be been being have has had having do does did doing a an and but if or because as until while of at by "
    "for with about against between into through during before after above below to from up down in out on off over under again further then once here there why all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don should now"
).split()
VARIANTS = {"vocabulary": ["vocab"], "dimension": ["dim", "dimensionality"], "transformer": ["attention"], "performance": ["accuracy"], "parameter": ["param"], "training": ["train"]}


def classify_query(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds query_type, confidence, top_k and balanced; needs ``history`` (bool) and ``paper_count``."""
    q = F.substring(F.regexp_replace(F.col(column), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), 1, 5000)
    n = F.size(F.array_remove(F.split(q, r"\s+"), ""))
    score = {"simple_qa": F.lit(0.3)} | {name: F.when(q.rlike("(?i)" + p), base).otherwise(0.0) for name, base, p in PATTERNS}
    named = q.rlike("(?i)" + PAPER_REFERENCE)
    score["summary"] = score["summary"] + F.when(named, 0.2).otherwise(0.0)
    score["comparison"] = score["comparison"] + F.when(named & (F.col("paper_count") > 1), 0.2).otherwise(0.0)
    score["follow_up"] = score["follow_up"] + F.when(n <= 8, 0.2).otherwise(0.0) + F.when(F.col("history") & (n <= 5) & q.rlike(r"(?i)\b(that|this|it|they)\b"), 0.4).otherwise(0.0)
    order = ["simple_qa", "comparison", "summary", "multi_hop", "follow_up", "metadata"]
    best = F.array_max(F.array(*[F.struct(F.round(score[name], 6).alias("score"), F.lit(-k).alias("rank"), F.lit(name).alias("name")) for k, name in enumerate(order)]))
    kind = F.when(best["score"] < 0.3, "simple_qa").otherwise(best["name"])
    top_k = F.lit(0)
    for name, k in TOP_K.items():
        top_k = F.when(F.col("query_type") == name, k).otherwise(top_k)
    out = df.withColumns({"query_type": kind, "query_confidence": F.least(best["score"], F.lit(1.0))})
    return out.withColumns({"top_k": top_k, "balanced": F.col("query_type") == "comparison"})


def query_keywords(text: Column) -> Column:
    """Distinct lower-case tokens without stop words and single letters, with their variants, sorted."""
    found = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]+)"), 1), lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))
    extra = F.array().cast("array<string>")
    for word, more in VARIANTS.items():
        extra = F.concat(extra, F.when(F.array_contains(found, word), F.array(*map(F.lit, more))).otherwise(F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.concat(found, extra)))


def hydrate(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the attributes of their chunks; a missing score is 0."""
    joined = hits.join(chunks, ["paper_id", "paragraph_id"])
    return joined.withColumn("score", F.coalesce("score", F.lit(0.0)))


def apply_paper_boost(hits: DataFrame, boosts: DataFrame) -> DataFrame:
    joined = hits.join(boosts.select("query_id", "paper_id", "boost"), ["query_id", "paper_id"], "left")
    return joined.withColumn("score", F.col("score") * F.coalesce("boost", F.lit(1.0))).drop("boost")


def target_papers(boosts: DataFrame) -> DataFrame:
    """The boosted papers of a query, or all where none is."""
    top = F.max("boost").over(Window.partitionBy("query_id"))
    return boosts.withColumn("_top", top).where((F.col("_top") <= 1) | (F.col("boost") > 1)).drop("_top")


def keyword_boost(hits: DataFrame, step: float = 0.15) -> DataFrame:
    """score * (1 + step * keywords found); needs ``text`` and ``keywords``."""
    low = F.lower("text")
    plain = F.replace(low, F.lit("_"), F.lit(""))
    found = F.size(F.filter("keywords", lambda k: F.contains(low, k) | F.contains(plain, F.replace(k, F.lit("_"), F.lit("")))))
    return hits.withColumn("score", F.col("score") * (1 + step * found))


def prefix_cap(hits: DataFrame, cap: int, key: str = "query_id") -> DataFrame:
    """The hits of each query, in rank order, up to the first that would exceed ``cap`` tokens."""
    running = F.sum("token_count").over(Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return hits.withColumn("running", running).where(F.col("running") <= cap)


def budget_balanced(hits: DataFrame, cap: int = 12_000) -> DataFrame:
    """First hit of each paper in list order, then the others by score; a chunk that does not fit is left out and later ones may fit.

    The choice of a query is sequential, so it is a fold over its own hits (a few dozen), not a join.
    """
    first = F.row_number().over(Window.partitionBy("query_id", "paper_id").orderBy("rank")) == 1
    flagged = hits.withColumn("is_rest", (~first).cast("int"))
    place = F.struct("is_rest", F.when(F.col("is_rest") == 1, -F.col("score")).otherwise(0.0).alias("by_score"), "rank", "paragraph_id", F.col("token_count").cast("long").alias("tokens"))
    grouped = flagged.groupBy("query_id").agg(F.array_sort(F.collect_list(place)).alias("hits"))
    start = F.struct(F.array().cast("array<struct<paragraph_id:string,tokens:bigint>>").alias("out"), F.lit(0).cast("long").alias("used"))

    def step(acc: Column, h: Column) -> Column:
        fits = acc["used"] + h["tokens"] <= cap
        item = F.struct(h["paragraph_id"].alias("paragraph_id"), h["tokens"].alias("tokens"))
        return F.struct(F.when(fits, F.array_append(acc["out"], item)).otherwise(acc["out"]).alias("out"), F.when(fits, acc["used"] + h["tokens"]).otherwise(acc["used"]).alias("used"))

    chosen = grouped.select("query_id", F.posexplode(F.aggregate("hits", start, step, lambda a: a["out"])).alias("place", "hit"))
    return chosen.select("query_id", "place", "hit.paragraph_id", F.col("hit.tokens").alias("token_count"))


def add_non_text(hits: DataFrame, chunks: DataFrame, queries: DataFrame, *, slots: int = 3, base: float = 0.15) -> DataFrame:
    """Up to ``slots`` figure, table or formula chunks per query and paper that are not among the hits, scored by query words found."""
    wanted = hits.select("query_id", "paper_id").distinct().join(queries.select("query_id", F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w) >= 3).alias("q_words")), "query_id")
    pool = wanted.join(chunks.where(F.col("chunk_type") != "text"), "paper_id").join(hits.select("query_id", "paper_id", "paragraph_id"), ["query_id", "paper_id", "paragraph_id"], "left_anti")
    found = F.size(F.filter("q_words", lambda w: F.contains(F.lower("text"), w)))
    scored = pool.withColumn("score", F.round(F.lit(base) + 0.1 * found, 6))
    rank = F.row_number().over(Window.partitionBy("query_id", "paper_id").orderBy(F.desc("score"), "ord"))
    return scored.withColumn("slot", rank).where(F.col("slot") <= slots)


def keyword_filter(hits: DataFrame) -> DataFrame:
    """Hits that hold a keyword; all where none does."""
    has = F.exists("keywords", lambda k: F.contains(F.lower("text"), k))
    flagged = hits.withColumn("_has", has).withColumn("_any", F.max("_has").over(Window.partitionBy("query_id")))
    return flagged.where(F.col("_has") | ~F.col("_any")).drop("_has", "_any")


def prune_papers(papers: DataFrame, hits: DataFrame) -> DataFrame:
    return papers.join(hits.select("paper_id").distinct(), "paper_id", "left_semi")


def missing_citations(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """query_id, cited: cited ids that are not among a query's hits."""
    cited = texts.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(CITATION), 1))).alias("cited"))
    return cited.join(hits.select("query_id", F.col("paragraph_id").alias("cited")), ["query_id", "cited"], "left_anti")


def add_cited(hits: DataFrame, texts: DataFrame, papers: DataFrame, chunks: DataFrame, *, score: float = 0.9) -> DataFrame:
    """query_id, paper_id, paragraph_id, text, score, added: the hits, and the chunks that a query's text cites and its hits lack.

    The paper of a citation is the query's first (by ``ord``) whose id's first 8 characters begin the cited id; the chunk is then looked up in that paper.  The beginnings of a cited id are written out, at most 8, so
    the match is a plain join.  A cited id without such a paper or chunk adds nothing.
    """
    missing = missing_citations(hits, texts)
    starts = missing.select("query_id", "cited", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(8), F.length("cited"))), lambda n: F.substring(F.col("cited"), F.lit(1), n))).alias("start"))
    named = papers.select("query_id", "paper_id", "ord", F.substring(F.col("paper_id").cast("string"), 1, 8).alias("start"))
    target = starts.join(named, ["query_id", "start"]).groupBy("query_id", "cited").agg(F.min_by("paper_id", "ord").alias("paper_id"))
    found = target.join(chunks.select("paper_id", F.col("paragraph_id").alias("cited"), "text"), ["paper_id", "cited"])
    added = found.select("query_id", "paper_id", F.col("cited").alias("paragraph_id"), "text", F.lit(score).alias("score"), F.lit(True).alias("added"))
    return hits.select("query_id", "paper_id", "paragraph_id", "text", "score", F.lit(False).alias("added")).unionByName(added)


def context_block(hits: DataFrame) -> DataFrame:
    """One text per query: ``[P12] (Section: s)``, a line feed and the text of each hit, in rank order."""
    tag = F.concat(F.lit("["), F.substring_index("paragraph_id", "_", -1), F.lit("]"))
    kind = F.when(F.col("chunk_type") != "text", F.concat(F.lit(" ["), F.upper("chunk_type"), F.lit("]"))).otherwise("")
    section = F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit(" (Section: "), F.col("section"), F.lit(")"))).otherwise("")
    block = F.concat(tag, kind, section, F.lit("\n"), "text")
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda b: b["block"]), "\n\n").alias("context"))


def history_block(messages: DataFrame, *, turns: int = 4, budget: int = 2500) -> DataFrame:
    """The newest ``2 * turns`` messages of a conversation, newest first up to the first that exceeds the budget, printed oldest first."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = messages.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= 2 * turns)
    running = F.sum("token_count").over(newest.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = recent.withColumn("running", running).where(F.col("running") <= budget)
    line = F.concat(F.initcap("role"), F.lit(": "), "text")
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("history"))
