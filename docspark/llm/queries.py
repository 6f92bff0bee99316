"""The queries of this package: each applies one operator to a whole table of the driver and derives the columns that are asked for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import bpe, fingerprint, html_text, license_scan, line_dedup, media, mixing, neighbours, prefix_trie, quality_rules, simhash, toxicity, url_filter, vector_codes
from docspark.llm.common import dealt, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")))
    base = F.filter("spans", lambda s: s["exact"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["first_word"].cast("long"))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranged, order, n = neighbours.with_ranges(docs, "doc_id", text_col="text")
    ranged = ranged.repartitionById(n, F.col("_range"))
    after = lambda c, *ties: F.lead(c).over(neighbours.window_of(order, *ties))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.coalesce(after("text", "text"), "text"), F.lit(1), half))
    rows = ranged.select("doc_id", "_range", "_after", "text", edited.alias("edited"))
    rows = rows.select(
        "doc_id", "_range", "_after", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.sha2("text", 256).alias("_tie"),
        fingerprint.word_hashes(F.col("text")).alias("_words"), fingerprint.word_hashes(F.col("edited")).alias("_edited_words"),
    )
    rows = fingerprint.add_fingerprints(rows, {"_words": "fingerprint", "_edited_words": "edited_fingerprint"})
    rows = rows.withColumn("next", F.coalesce(after("fingerprint", "_tie"), "fingerprint")).where("not _after")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        fingerprint.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), fingerprint.likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")), path=public_tokenizers.path(RANKS), pattern=public_tokenizers.PATTERN)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    docs = table(spark, sf_dir, "documents").select(F.struct("doc_id", n_bytes).alias("key"), "text")
    stored = media.store_texts(docs, id_col="key")
    return media.stored_digests(stored, id_col="key").select("key.doc_id", "key.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(dealt(table(spark, sf_dir, "pages")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.learn(docs, table(spark, sf_dir, "labels")).score(dealt(docs.select("doc_id", "text")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    listed = url_filter.marked_urls(pages).union(url_filter.mirrored_urls(pages))
    return url_filter.filter_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.simhash_classes(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return classes.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    codes = vector_codes.with_label_errors(made.codes)
    return codes.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(made.sha256()).alias("codebooks_sha256"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.clean_documents(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")), with_text=False).drop("lost")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_nodes(prefix_trie.rebuilt_paths(table(spark, sf_dir, "conversations")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_fingerprint, op3_bpe, op4_media, op5_html_text, op6_mixing, op7_toxicity, op8_url_filter, op9_line_dedup, op10_simhash, op11_vector_codes, op12_quality_rules, op13_prefix_trie, pipeline)
}
