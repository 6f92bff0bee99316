"""Claims against sources: levels, reranking, merging, citations, attribution types and their summaries."""

from __future__ import annotations

import bisect
import difflib
import functools
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.text import CITATION, confidence, sigmoid, word_count

# Lead-ins that are cut off a claim before it is compared, and words that compare.
LEAD_INS = [
    "in the paper, ", "in the transformer paper, ", "in this paper, ", "according to the paper, ", "the paper states that ", "the paper states ", "based on the paper, ", "as described in the paper, ",
    "as described in the transformer paper, ", "the paper mentions that ", "the paper mentions ", "according to vaswani et al., ", "according to devlin et al., ", "according to radford et al., ",
    "in the transformer architecture, ", "in the original transformer, ",
]
COMPARATIVE = r"\b(both|while|whereas|differ|compare|contrast|instead|similar|unlike)\b"
#: Pairs of texts whose likeness a task remembers.
REMEMBERED = 4096
#: Characters from which a text's places are too many for one number of bits each.
LONG = 4096
#: Parts into which the answers of each split of the tables are dealt where each is sorted.
PARTS = 4
TYPES = ["direct_quote", "paraphrase", "synthesis", "inference", "uncertain", "unsupported"]


def split_short(claims: DataFrame, least_words: int = 5) -> DataFrame:
    """Adds is_short (fewer words and no citation) and the output order: short claims first."""
    short = (word_count(F.col("claim")) < least_words) & ~F.col("claim").rlike(CITATION)
    return claims.withColumn("is_short", short).withColumn("place", F.row_number().over(Window.partitionBy("answer_id").orderBy(F.desc("is_short"), "claim_idx")))


def rerank_candidates(claims: DataFrame, sources: DataFrame, k: int = 3) -> DataFrame:
    """For claims that need it: the first ``3 k`` sources of the request in order, and the last sentence of the cited paragraph; distinct."""
    w = Window.partitionBy("answer_id").orderBy("ord", "text")
    first = sources.withColumn("n", F.row_number().over(w)).where(F.col("n") <= 3 * k)
    asked = claims.where("needs_rerank").select("answer_id", "claim_idx", F.regexp_extract("claim", CITATION, 1).alias("cited"))
    pool = asked.select("answer_id", "claim_idx").join(first.select("answer_id", "text"), "answer_id")
    last = sources.groupBy("answer_id", F.col("paragraph_id").alias("cited")).agg(F.max_by("text", "ord").alias("text"))
    return pool.unionByName(asked.join(last, ["answer_id", "cited"]).select("answer_id", "claim_idx", "text")).distinct()


def rerank(pairs: DataFrame, *, high: float = 0.85, medium: float = 0.75) -> DataFrame:
    """Best raw score per claim if above -1, else none; sigmoid and levels."""
    best = pairs.groupBy("answer_id", "claim_idx").agg(F.max(F.when(F.col("raw_score") > -1, F.struct("raw_score", (-F.col("ord")).alias("first"), "source"))).alias("best"))
    score = F.when(F.col("best").isNotNull(), sigmoid(F.col("best.raw_score")))
    return best.select("answer_id", "claim_idx", F.col("best.source").alias("source"), F.round(score, 6).alias("score"), F.coalesce(F.when(score.isNotNull(), confidence(score, high, medium)), F.lit("low")).alias("confidence"))


def merge_results(claims: DataFrame, level1: DataFrame, level2: DataFrame) -> DataFrame:
    """One row per claim of each answer, by answer and claim text; level 2 overrides; scores within 0 and 1.

    Claims of one answer with the same text share a result; those of different answers never meet, so a claim that many answers make is no hot key.
    """
    keys = ["answer_id", "claim"]
    last = lambda df, to: df.groupBy(*keys).agg(F.max_by(F.struct("score", "confidence"), "ord").alias(to))
    out = claims.join(last(level1, "l1"), keys, "left").join(last(level2, "l2"), keys, "left")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("l2.score", "l1.score", F.lit(0.0))))
    method = F.when(F.col("l2").isNotNull(), "cross_encoder_rerank").when(F.col("l1").isNotNull(), "embedding_similarity").otherwise("skipped")
    return out.select("answer_id", "claim_idx", "claim", score.alias("score"), F.coalesce("l2.confidence", "l1.confidence", F.lit("low")).alias("confidence"), method.alias("method"))


def missing_sources(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims of answers that have no source at all: low, 0, skipped."""
    return claims.join(sources.select("answer_id").distinct(), "answer_id", "left_anti").withColumns({"score": F.lit(0.0), "confidence": F.lit("low"), "method": F.lit("skipped")})


def distinct_missing(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """answer_id, claim_idx, claim, each once, of the claims of answers without a source.

    Answers are dealt into as many parts as the tables have splits and more, so a task holds no more of a larger table; sources and claims of a part are sorted once, a source before the claims of its answer, and equal claims follow each other.
    """
    marks = sources.select("answer_id", F.lit(None).cast(claims.schema["claim_idx"].dataType).alias("claim_idx"), F.lit(None).cast("string").alias("claim"), F.lit(0).alias("is_claim"))
    both = claims.select("answer_id", "claim_idx", "claim", F.lit(1).alias("is_claim")).unionByName(marks)
    parts = max(both.rdd.getNumPartitions() * PARTS, int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    w = Window.partitionBy("answer_id").orderBy("is_claim", "claim_idx", "claim")
    same = F.col("claim_idx").eqNullSafe(F.lag("claim_idx").over(w)) & F.col("claim").eqNullSafe(F.lag("claim").over(w)) & F.lag("is_claim", 1, 0).over(w).eqNullSafe(1)
    told = both.repartition(parts, "answer_id").withColumns({"_sourced": F.first("is_claim").over(w) == 0, "_same": same})
    return told.where("is_claim = 1 and answer_id is not null and not _sourced and not _same").select("answer_id", "claim_idx", "claim").unionByName(claims.where("answer_id is null").select("answer_id", "claim_idx", "claim").distinct())


def verification_summary(results: DataFrame, key: str = "answer_id") -> DataFrame:
    level = lambda name: F.count_if(F.col("confidence") == name).alias(name)
    return results.groupBy(key).agg(F.count("*").alias("claims"), level("high"), level("medium"), level("low"), F.round(F.avg("score"), 6).alias("mean_score"))


def _cleaned(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", text.lower().strip())).strip()


def matched(a: str, b: str) -> int:
    """Characters in the matching blocks of ``difflib.SequenceMatcher(None, a, b)``: the longest run of both texts, first in ``a``, then in ``b``, and the same left and right of it; characters frequent in a ``b`` of 200 or more begin none.

    ``runs[n][i]`` has a bit for each place of ``b`` where a run of more than ``n`` characters ends that ends at ``i`` in ``a``, so the runs are found once, not again in each part.
    """
    if len(b) > LONG:
        return sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
    at: dict[str, int] = {}
    for j, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << j
    if len(b) >= 200:
        at = {c: places for c, places in at.items() if places.bit_count() <= len(b) // 100 + 1}
    level = {i: places for i, c in enumerate(a) if (places := at.get(c))}
    runs, ends = [], []
    while level:
        runs.append(level)
        ends.append(list(level))
        level = {i + 1: places for i, before in level.items() if (n := runs[0].get(i + 1)) and (places := before << 1 & n)}
    total, parts = 0, [(0, len(a), 0, len(b), len(runs))]
    while parts:
        alo, ahi, blo, bhi, most = parts.pop()
        inside, n, end_a, j = (1 << bhi) - 1, min(most, ahi - alo, bhi - blo), alo, blo
        while n:
            level, where, left = runs[n - 1], ends[n - 1], -1 << blo + n - 1
            for i in where[bisect.bisect_left(where, alo + n - 1) : bisect.bisect_left(where, ahi)]:
                if places := level[i] & inside & left:
                    end_a, j = i + 1, (places & -places).bit_length()
                    break
            else:
                n -= 1
                continue
            break
        x, y = end_a - n, j - n  # without a run it is the start of both parts, which may go on in frequent characters
        while x > alo and y > blo and a[x - 1] == b[y - 1]:
            x, y = x - 1, y - 1
        while end_a < ahi and j < bhi and a[end_a] == b[j]:
            end_a, j = end_a + 1, j + 1
        if end_a > x:
            total += end_a - x
            if alo < x and blo < y:
                parts.append((alo, x, blo, y, n))
            if end_a < ahi and j < bhi:
                parts.append((end_a, ahi, j, bhi, n))
    return total


def string_ratio(claim: str | None, source: str | None) -> float:
    """Matching-blocks ratio of the normalised texts, the claim without its lead-in; 0 if either is empty."""
    if not claim or not source:
        return 0.0
    low = claim.lower().strip()
    lead = next((p for p in LEAD_INS if low.startswith(p)), "")
    a, b = _cleaned(claim[len(lead) :]), _cleaned(source)
    return 2.0 * matched(a, b) / (len(a) + len(b)) if a and b else 0.0


def ratios_of(pairs: Iterable[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """``string_ratio`` of the pairs of each batch; one that comes again is not compared again (the last ``REMEMBERED``)."""
    ratio = functools.lru_cache(REMEMBERED)(string_ratio)
    for claims, sources in pairs:
        yield pd.Series([ratio(a, b) for a, b in zip(claims, sources, strict=True)], dtype=float)


def string_similarity(claim: Column, source: Column) -> Column:
    """``string_ratio`` as a column."""

    @F.pandas_udf("double")
    def ratios(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from ratios_of(pairs)

    return ratios(claim, source)


def source_dominance(results: DataFrame) -> DataFrame:
    """answer_id, top, second, is_dominant: whether one paper carries an answer. Needs answer_id, paper_id, score."""
    best = results.groupBy("answer_id", "paper_id").agg(F.max("score").alias("score"))
    top = best.groupBy("answer_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
    a, b = F.get("scores", F.lit(0)), F.get("scores", F.lit(1))
    dominant = F.when(b.isNull(), True).when((a > 0.75) & (b < a - 0.12 + 1e-6), True).when((a > 0.45) & (b > 0.45), False).otherwise(True)
    return top.select("answer_id", a.alias("top"), b.alias("second"), dominant.alias("is_dominant"))


def classify_attribution(df: DataFrame) -> DataFrame:
    """Adds attribution and attribution_confidence; needs claim, semantic, cross_encoder, string_similarity, is_dominant, n_sources."""
    sem, ce = F.coalesce("semantic", F.lit(0.0)), F.coalesce("cross_encoder", F.lit(0.0))
    compares = F.lower("claim").rlike(COMPARATIVE)
    kind = (
        F.when(sem < 0.40, "unsupported").when((F.col("string_similarity") > 0.75) & (sem > 0.80), "direct_quote").when(~F.col("is_dominant") | (compares & (F.col("n_sources") > 1)), "synthesis")
        .when(sem > 0.70, "paraphrase").when((sem > 0.40) & (sem < 0.70) & (ce > 0.50), "inference").otherwise("uncertain")
    )
    sure = F.lit(0.50)
    for name, value in (("unsupported", 0.90), ("direct_quote", 0.94), ("synthesis", 0.82), ("paraphrase", 0.86), ("inference", 0.70)):
        sure = F.when(F.col("attribution") == name, value).otherwise(sure)
    return df.withColumn("attribution", kind).withColumn("attribution_confidence", sure)


def attribution_summary(results: DataFrame) -> DataFrame:
    """Per answer: claims, mean score in percent, least score, counts by type (null counts as uncertain), whether any is inferred."""
    kind = F.coalesce("attribution", F.lit("uncertain"))
    counts = [F.count_if(kind == t).alias(f"n_{t}") for t in TYPES]
    return results.groupBy("answer_id").agg(F.count("*").alias("claims"), F.round(F.avg("score") * 100, 4).alias("mean_percent"), F.round(F.min("score"), 6).alias("weakest"), (F.count_if(kind == "inference") > 0).alias("any_inference"), *counts)


def contradictions(results: DataFrame, gap: float = 0.25) -> DataFrame:
    """Answers with two papers or more whose best scores lie more than ``gap`` apart."""
    best = results.groupBy("answer_id", "paper_id").agg(F.max("score").alias("score"))
    spread = best.groupBy("answer_id").agg(F.count("*").alias("papers"), F.round(F.max("score") - F.min("score"), 6).alias("spread"))
    return spread.where("papers >= 2").withColumn("contradicts", F.col("spread") > gap)


def cited_ids(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(CITATION), 1))


def resolve_citations(cited: DataFrame, valid: DataFrame) -> DataFrame:
    """answer_id, cited, resolved: exact ids stay, a short id becomes the only valid id with that suffix, others stay as they are."""
    exact = cited.join(valid.select("answer_id", F.col("paragraph_id").alias("cited"), F.lit(True).alias("known")), ["answer_id", "cited"], "left")
    suffix = valid.select("answer_id", F.substring_index("paragraph_id", "_", -1).alias("cited"), "paragraph_id").where(F.col("paragraph_id").contains("_"))
    one = suffix.groupBy("answer_id", "cited").agg(F.count_distinct("paragraph_id").alias("n"), F.max("paragraph_id").alias("full")).where("n = 1")
    joined = exact.join(one, ["answer_id", "cited"], "left")
    return joined.select("answer_id", "cited", F.when(F.col("known") | F.col("cited").contains("_"), F.col("cited")).otherwise(F.coalesce("full", "cited")).alias("resolved"))


def validate_citations(answers: DataFrame, valid: DataFrame) -> DataFrame:
    """answer_id, text, has_citations: short ids made long, unknown ones taken out, blanks collapsed."""
    cited = answers.select("answer_id", F.explode(cited_ids(F.col("text"))).alias("cited"))
    known = valid.select("answer_id", F.col("paragraph_id").alias("resolved"), F.lit(True).alias("known")).distinct()
    changes = resolve_citations(cited, valid).join(known, ["answer_id", "resolved"], "left")
    to = F.when(F.col("known"), F.concat(F.lit("["), "resolved", F.lit("]"))).otherwise("")
    per = changes.groupBy("answer_id").agg(F.collect_list(F.struct(F.concat(F.lit("["), "cited", F.lit("]")).alias("tag"), to.alias("to"))).alias("changes"))
    joined = answers.join(per, "answer_id", "left")
    text = F.when(F.col("changes").isNull(), F.col("text")).otherwise(F.aggregate("changes", F.col("text"), lambda t, c: F.replace(t, c["tag"], c["to"])))
    return joined.select("answer_id", F.trim(F.regexp_replace(text, r"[ \t]{2,}", " ")).alias("text"), F.exists(F.coalesce("changes", F.array().cast("array<struct<tag:string,to:string>>")), lambda c: c["to"] != "").alias("has_citations"))
