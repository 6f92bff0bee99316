"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LABELS = (
    "claims array<struct<id:string,question_number:int,claim:string,source_sentence:string,source_paper:string,source_page:int,transformation_type:string,is_accurate:boolean,notes:string>>"
)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """A typed table; JSON needs a schema, so nothing is inferred."""
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    return reader.option("multiLine", True).load(path) if fmt == "json" else reader.load(path)


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """The claims of an annotation file, one row each."""
    return read_table(spark, path, "json", LABELS).select(F.explode("claims").alias("c")).select("c.*")


def scan_uploads(spark: SparkSession, path: str, max_mb: float = 50.0) -> DataFrame:
    """Files of a folder with the reason for which each is rejected: extension, size or signature; null if it is admitted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    reason = F.when(~F.lower("path").endswith(".pdf"), "extension").when(F.col("length") > max_mb * 1048576, "size").when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "signature")
    return files.select("path", "length", reason.alias("reject_reason"), F.sha2("content", 256).alias("content_hash"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks by session; a replay overwrites only the sessions that it holds."""
    chunks.write.partitionBy("session_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_flat_exports(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def _escaped(c: Column) -> Column:
    # Replacements in this order.
    for char, to in (("\\", "\\textbackslash{}"), ("&", "\\&"), ("%", "\\%"), ("$", "\\$"), ("#", "\\#"), ("_", "\\_"), ("{", "\\{"), ("}", "\\}"), ("~", "\\textasciitilde{}"), ("^", "\\textasciicircum{}")):
        c = F.replace(c, F.lit(char), F.lit(to))
    return c


def bibtex_entries(papers: DataFrame) -> DataFrame:
    """paper_id, cite_key, entry. Key: last name of the first author (text before a comma, else last word) and year, else title words and year, else ``paper_`` and id.

    Papers with the same key are numbered from 2 in ``ord`` order.  A numbered key that equals another paper's own key moves on in a second pass.
    """
    year = F.coalesce(F.col("year").cast("string"), F.lit("XXXX"))
    first = F.trim(F.split_part(F.split_part(F.coalesce("authors", F.lit("")), F.lit(";"), F.lit(1)), F.lit("and"), F.lit(1)))
    last = F.when(first.contains(","), F.trim(F.split_part(first, F.lit(","), F.lit(1)))).otherwise(F.element_at(F.split(first, r"\s+"), -1))
    safe = F.regexp_replace(last, "[^A-Za-z0-9_-]", "")
    words = F.slice(F.filter(F.split(F.regexp_replace(F.coalesce("title", F.lit("")), "[^A-Za-z0-9 ]", ""), " +"), lambda w: w != ""), 1, 3)
    title = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000)))), "")
    key = F.when(safe != "", F.substring(F.concat(safe, year), 1, 30)).when(title != "", F.substring(F.concat(title, year), 1, 30)).otherwise(F.concat(F.lit("paper_"), F.substring(F.col("paper_id").cast("string"), 1, 8)))
    keyed = papers.withColumn("base", key).withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy("ord")))
    keyed = keyed.withColumn("cite_key", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.col("n").cast("string"))))
    taken = keyed.where("n = 1").select(F.col("base").alias("cite_key"), F.lit(True).alias("taken"))
    final = keyed.join(taken, "cite_key", "left").withColumn("cite_key", F.when((F.col("n") > 1) & F.coalesce("taken", F.lit(False)), F.concat("cite_key", F.lit("x"))).otherwise(F.col("cite_key")))
    field = lambda name, c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"  {name} = {{"), _escaped(F.trim(F.regexp_replace(F.col(c).cast("string"), r"\s+", " "))), F.lit("},")))
    entry = F.concat_ws("\n", F.concat(F.lit("@article{"), "cite_key", F.lit(",")), field("title", "title"), field("author", "authors"), field("year", "year"), F.lit("}"))
    return final.select("paper_id", "cite_key", entry.alias("entry"))


def write_bibtex(papers: DataFrame, path: str) -> None:
    bibtex_entries(papers).select("entry").write.mode("overwrite").text(path, lineSep="\n\n")
