"""A corpus pipeline of five stages over ``documents``; counted as part of the package ``docspark.llm``.

Each stage works on all that the one before kept and is written as Parquet before the next reads it.

Rows are told apart by id and a hash of the text, never by the id alone, so rows without an id, or with one id and different texts, are documents of their own; rows that repeat both are
one document, whose copies share every verdict.  Null texts count as empty.  An empty table gives an empty one at each stage.  Only the columns of ``documents`` are read, whatever others there are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import bpe, line_dedup, mixing, simhash, toxicity
from docspark.llm.common import Rounds, cut, table
from docspark.llm.queries import RANKS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score is 0.5 or more; each row has a score of its own text, also where ids repeat or are null."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    key = F.struct(*COLUMNS)
    return model.score(docs.select(key.alias("row"), "text"), id_col="row").where("score < 0.5").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without repeated lines; a document that loses all its lines goes. Null and empty texts stay; repeated rows lose the same lines."""
    left = line_dedup.dedup_lines(docs.select(COLUMNS))
    left = left.where("lines_removed = 0 or lines_removed < lines_before")
    n_chars = F.when(F.col("lines_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return left.withColumn("n_chars", n_chars).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id and hash of the text, of each class of near-duplicates: shingles of five words, similarity 0.8 or more.

    Texts without words are one class.  Rows without an id stay all, since nothing says which of them is the one that stays.
    """
    return simhash.drop_near_duplicates(docs.select(COLUMNS), width=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; texts without words are taken no time, null is a source of its own, repeated rows are taken each by itself."""
    taken = mixing.mix_sources(docs, keep=tuple(COLUMNS)).where("taken > 0")
    return taken.select("row", F.explode(F.expr("sequence(1, cast(taken div size as int))"))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    return bpe.encoding_digests(docs, path=public_tokenizers.path(RANKS), pattern=public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("simhash near-dedup", drop_near_duplicates), ("mixing", mix), ("byte-level BPE", encode)]

#: Learned scores, seeded choices and token ids have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each is written to the session's shared checkpoint folder and read again, and goes once the next one is written; the last one is a checkpoint."""
    docs, written = table(spark, sf_dir, "documents"), Rounds(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = written.written(stage(spark, docs, sf_dir))
    out = cut(STAGES[-1][1](spark, docs, sf_dir))
    written.remove()
    return out
