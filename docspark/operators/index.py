"""A stored vector index: each text is encoded once, by the hash of its content.

Two tables in one folder, both under ``Versions``: ``entries`` says which paragraph of which paper has which hash, by paper, and ``codes`` holds the unit vector of every hash, by bucket of the hash and commit.
Only texts whose hash has no vector are encoded, in one pass that ends in the stored file; retrieval reads the vectors and never encodes a chunk.
Hashes move to find out which texts are new; a text moves only if its hash may be there already or come twice, and papers whose entries are what they were are passed over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators.flows import embed
from docspark.sources.scratch import kept
from docspark.sources.versions import Refused, Versions

CAPACITY = 200_000
#: Words of 64 bits in a broadcast filter at most, 8 MB with their numbers. Up to 2 million keys fewer than one other key in a hundred pass (0.5 % in a simulation, 3 % with 4 million); with more keys more do, which costs time but no result.
BLOCKS = 1 << 19


def _place(key: str, blocks: int) -> tuple[Column, Column]:
    """The word of a key, and its four bits there."""
    bits, hashed = F.lit(0).cast("long"), F.xxhash64(F.lit(1), key)
    for k in range(4):
        at = F.shiftrightunsigned(hashed, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return F.pmod(F.xxhash64(key), F.lit(blocks)), bits


def marked(rows: DataFrame, key: str, keys: DataFrame, most: int) -> DataFrame:
    """``rows`` with ``marked``: true if the key is one of ``keys`` (``most`` of them at most), and now and then if it is not. The rows stay where they are."""
    block, bits = _place(key, max(1, min(BLOCKS, most // 4)))
    words = keys.select(block.alias("_block"), bits.alias("_bits")).groupBy("_block").agg(F.bit_or("_bits").alias("_word"))
    found = rows.withColumn("_block", block).join(F.broadcast(words), "_block", "left")
    return found.withColumn("marked", F.coalesce(F.col("_word").bitwiseAND(bits) == bits, F.lit(False))).drop("_block", "_word")


def _by_paper(entries: DataFrame, n: str, digest: str) -> DataFrame:
    """How many entries a paper has, and 128 bits of what they are in any order."""
    sums = [F.sum(F.xxhash64(F.lit(k), "paragraph_id", "content_hash").cast("decimal(20,0)")) for k in range(2)]
    return entries.groupBy("paper_id").agg(F.count("*").alias(n), F.struct(*sums).alias(digest))


class VectorIndex:
    def __init__(self, spark: SparkSession, folder: str, *, encoder: Callable | None = None, capacity: int = CAPACITY) -> None:
        self.encoder, self.capacity = encoder, capacity
        self.entries = Versions(spark, f"{folder}/entries", {"entries": "paper_id long, paragraph_id string, content_hash binary"})
        # Vectors are added and never replaced: the key of their commits is the commit's own name.
        self.codes = Versions(spark, f"{folder}/codes", {"codes": "batch string, content_hash binary, vector array<float>"}, key="batch", few=True)

    def add(self, chunks: DataFrame, *, text: str = "enriched_text") -> int:
        """Indexes the papers of ``chunks`` (paper_id, paragraph_id and the text), replacing what they had; refused as a whole if more entries than the capacity would be live.  Returns how many texts were encoded.

        Vectors are committed before the entries that need them, so a failure between the two leaves vectors without entries, which the next attempt uses.  Papers that have the same entries already are not written again.
        """
        body = F.coalesce(text, F.lit(""))
        keyed = chunks.select("paper_id", "paragraph_id", F.unhex(F.sha2(body, 256)).alias("content_hash"), body.alias("text"))
        last = self.entries.last()
        met = _by_paper(keyed, "n", "digest").join(_by_paper(self.entries.read("entries"), "had", "had_digest"), "paper_id", "full")
        papers = kept(met.select("paper_id", "n", "had", (F.col("n").isNotNull() & ~F.col("digest").eqNullSafe(F.col("had_digest"))).alias("changed")))
        of = papers.agg(F.sum("n").alias("rows"), F.sum(F.coalesce("n", "had")).alias("total"), F.count("n").alias("papers"), F.count_if("changed").alias("changed")).first()
        if (of["total"] or 0) > self.capacity:
            raise Refused(f"{of['total']} vectors would exceed the capacity of {self.capacity}")
        if not of["changed"]:
            return 0
        entries = keyed
        if of["changed"] < of["papers"]:
            changed = papers.where("changed").select("paper_id")
            keyed = marked(keyed, "paper_id", changed, of["changed"]).where("marked").drop("marked")
            entries = keyed.drop("text").join(changed, "paper_id", "left_semi")
        made = embed(self._new(keyed.drop("paper_id", "paragraph_id"), of["rows"]), "text", encoder=self.encoder)
        number = self.codes.write({"codes": made.select(F.lit(f"{len(self.codes.commits()) + 1}").alias("batch"), "content_hash", "vector")})
        self.entries.write({"entries": entries.select("paper_id", "paragraph_id", "content_hash")}, after=last)
        return self.codes.read("codes").where(F.col("batch") == str(number)).count()

    def _new(self, texts: DataFrame, most: int) -> DataFrame:
        """content_hash, text of each text without a vector, once. Texts that come once and are not there are taken where they are."""
        held = self.codes.read("codes").select("content_hash")
        key, texts = F.xxhash64("content_hash").alias("key"), texts.withColumn("key", F.xxhash64("content_hash"))
        each = texts.select("key", F.lit(1).alias("own")).unionByName(held.select(key, F.lit(0).alias("own"))).groupBy("key").agg(F.sum("own").alias("own"), F.count("*").alias("n"))
        found = marked(texts, "key", each.where("own > 0 and n > 1").select("key"), most)
        once = found.where("not marked").select("content_hash", "text")
        rest = found.where("marked").select("content_hash", "text").dropDuplicates(["content_hash"]).join(held, "content_hash", "left_anti")
        return once.unionByName(rest)

    def remove(self, papers: DataFrame) -> None:
        """Their vectors stay for papers with the same texts, until ``compact``."""
        self.entries.delete(papers)

    def vectors(self) -> DataFrame:
        """paper_id, paragraph_id, vector of every live entry."""
        return self.entries.read("entries").join(self.codes.read("codes").dropDuplicates(["content_hash"]), "content_hash").select("paper_id", "paragraph_id", "vector")

    def compact(self) -> None:
        """One commit with the vectors that an entry names; the others go."""
        wanted = self.codes.read("codes").join(self.entries.read("entries").select("content_hash").distinct(), "content_hash", "left_semi")
        done = len(self.codes.commits())
        self.codes.write({"codes": wanted.withColumn("batch", F.lit(f"{done + 1}"))})
        # A failure here leaves vectors twice, which readers take once.
        self.codes.delete(self.codes.live().where(F.col("batch") != f"{done + 1}"))
