"""Queries over tables that are written in commits, the stored index, and what depends on the order of events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docspark.operators import chat, index, keywords, layout, library
from docspark.plans import fixtures as fx
from docspark.plans.fixtures import table
from docspark.plans.registry import query
from docspark.sources import tables
from docspark.sources.scratch import scratch
from docspark.sources.versions import Versions

TABLES = {"papers": "paper_id long, session_id string", "chunks": "paper_id long, paragraph_id string, token_count long"}


def _stored(spark, d) -> Versions:
    """All documents as papers with their chunks, in one commit."""
    store = Versions(spark, scratch(spark), TABLES)
    store.write({"papers": fx.documents(spark, d).select(F.col("doc_id").alias("paper_id"), F.col("source").alias("session_id")), "chunks": fx.chunks(spark, d)})
    return store


@query(f"WITH {fx.CHUNKS_SQL} SELECT paper_id, paragraph_id, token_count FROM chunks WHERE paper_id % 3 <> 0 OR ord % 2 = 0")
def s06_write_versions(spark, d):
    """All papers, and then every third one again with every second chunk."""
    store = _stored(spark, d)
    store.write({"chunks": fx.chunks(spark, d).where("paper_id % 3 = 0 and ord % 2 = 0")}, papers=fx.documents(spark, d).where("doc_id % 3 = 0").select(F.col("doc_id").alias("paper_id")))
    return store.read("chunks")


@query(f"""WITH {fx.CHUNKS_SQL} SELECT 'papers' AS name, source AS session_id, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source
UNION ALL SELECT 'chunks', session_id, count(*) FROM chunks WHERE paper_id NOT IN (SELECT doc_id FROM labels) GROUP BY session_id""")
def s08_delete_cascade(spark, d):
    """Papers and chunks of each session after the labelled documents are deleted."""
    store = _stored(spark, d)
    store.delete(table(spark, d, "labels").select(F.col("doc_id").alias("paper_id")))
    papers = store.read("papers")
    held = store.read("chunks").join(fx.documents(spark, d).select(F.col("doc_id").alias("paper_id"), F.col("source").alias("session_id")), "paper_id")
    count = lambda df, name: df.groupBy("session_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "session_id", "n")
    return count(papers, "papers").unionByName(count(held, "chunks"))


@query(f"WITH {fx.CHUNKS_SQL}, h AS (SELECT paper_id, count(*) AS entries FROM chunks GROUP BY paper_id) SELECT h.*, (SELECT count(DISTINCT text) FROM chunks) AS encoded, 0::BIGINT AS encoded_again FROM h")
def r02_stored_index(spark, d):
    """Entries of each paper, and how many texts were encoded when all chunks were added, and when they were added again."""
    store = index.VectorIndex(spark, scratch(spark), capacity=1 << 40)
    chunks = fx.chunks(spark, d).select("paper_id", "paragraph_id", "text")
    encoded = [store.add(chunks, text="text") for _ in range(2)]
    counted = store.vectors().groupBy("paper_id").agg(F.count("*").alias("entries"))
    return counted.select("paper_id", "entries", F.lit(encoded[0]).cast("long").alias("encoded"), F.lit(encoded[1]).cast("long").alias("encoded_again"))


@query("""WITH b AS (SELECT DISTINCT user_id % 20 AS batch_id, user_id AS paper_id, epoch_us(min(ts) OVER (PARTITION BY user_id % 20)) + 86400000000 * (user_id % 20) + 660000000 AS deadline FROM events),
k AS (SELECT batch_id, count(*) AS total, min(deadline) AS deadline FROM b GROUP BY batch_id),
t AS (SELECT user_id % 20 AS batch_id, user_id AS paper_id, event_id, epoch_us(ts) AS t, CASE event_id % 4 WHEN 0 THEN 'failed' WHEN 3 THEN 'queued' ELSE 'completed' END AS s FROM events),
u AS (SELECT t.*, total, (s <> 'queued')::INT AS settled, (s = 'completed')::INT AS completed FROM t JOIN k USING (batch_id) WHERE t <= deadline),
w AS (SELECT *, settled - coalesce(lag(settled) OVER p, 0) AS ds, completed - coalesce(lag(completed) OVER p, 0) AS dc FROM u WINDOW p AS (PARTITION BY batch_id, paper_id ORDER BY t, event_id)),
r AS (SELECT *, sum(ds) OVER o AS n, sum(dc) OVER o AS c FROM w WINDOW o AS (PARTITION BY batch_id ORDER BY t, event_id)),
f AS (SELECT batch_id, arg_min(struct_pack(t := t, c := c), struct_pack(t := t, e := event_id)) AS x FROM r WHERE n = total GROUP BY batch_id)
SELECT batch_id, coalesce(x.t, deadline) AS at, total, coalesce(x.c, 0)::BIGINT AS completed, CASE WHEN x IS NULL THEN 0 ELSE total - x.c END::BIGINT AS failed, x IS NOT NULL AS done FROM k LEFT JOIN f USING (batch_id)""")
def e04_batch_completions(spark, d):
    """Batches of all users whose number leaves the same rest, a day apart."""
    status = F.get(F.array(*[F.lit(x) for x in ("FAILED", "Completed", "completed", "queued")]), (F.col("event_id") % 4).cast("int"))
    every, batch = table(spark, d, "events"), F.col("user_id") % 20
    first = every.groupBy(batch.alias("batch_id")).agg((F.min("ts") + F.make_dt_interval(F.first(batch).cast("int"))).alias("started"))
    batches = every.select(batch.alias("batch_id"), F.col("user_id").alias("paper_id")).distinct().join(first, "batch_id")
    return library.batch_completions(every.select("event_id", F.col("user_id").alias("paper_id"), batch.alias("batch_id"), "ts", status.alias("status")), batches)


@query()
def n02_mmr_keywords(spark, d):
    """Spread-out keywords of all documents."""
    return keywords.mmr_keywords(fx.documents(spark, d).select("doc_id", "text"))


@query()
def v11_chat(spark, d):
    """Questions of the chats whose number is divisible by 100 to the papers of a source, and the answers to them, each citing a chunk of its own source."""
    docs = fx.documents(spark, d)
    chunks = fx.chunks(spark, d)
    papers = docs.select(F.col("source").alias("session_id"), F.col("doc_id").alias("paper_id"), F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 60).alias("title"))
    turns = table(spark, d, "conversations").where(F.col("conv_id") % 100 == 0)
    session = F.concat(F.lit("src"), (F.col("conv_id") / 100 % 20).cast("int").cast("string"))
    number = (F.col("conv_id") * 100 + F.floor(F.col("turn") / 2)).alias("query_id")
    asked = turns.where("role = 'user'").select(number, session.alias("session_id"), F.concat("text", F.when(F.col("turn") % 4 == 0, " see paper 1").otherwise("")).alias("text"), (F.col("turn") > 0).alias("history"), F.lit(3).alias("paper_count"))
    cited = chunks.where("ord = 0").groupBy("session_id").agg(F.max("paragraph_id").alias("cited"))
    answers = turns.where("role = 'assistant'").select(number, session.alias("session_id"), "text").join(cited, "session_id", "left").select("query_id", F.concat("text", F.coalesce(F.concat(F.lit(" Cited is ["), "cited", F.lit("].")), F.lit(""))).alias("text"))
    chosen, left = chat.contexts(asked, papers, chunks, keywords={"rights": ["rights", "license"]})
    made = chat.verified_answers(answers, chosen, left, chunks)
    return made.select("answer_id", "claim_idx", "paper_id", "paragraph_id", F.round("score", 4).alias("score"), "confidence", "method", "attribution", "from_citation", "no_sources")


@query("SELECT doc_id, source, n_chars FROM documents")
def s01_read_table(spark, d):
    """Written as text files with a header and read back with its types."""
    folder, schema = scratch(spark), "doc_id long, source string, n_chars long"
    tables.write_flat_exports(table(spark, d, "documents").select("doc_id", "source", "n_chars"), folder, "csv")
    return tables.read_table(spark, folder, "csv", schema)


@query("SELECT CAST(doc_id AS VARCHAR) AS id, quality AS question_number, toxic = 0 AS is_accurate, 'claim ' || CAST(doc_id AS VARCHAR) AS claim FROM labels")
def l01_load_labels(spark, d):
    """Labels as annotation files of claims, one a remainder of the id, and read back."""
    doc, folder = F.col("doc_id").cast("string"), scratch(spark)
    claim = F.struct(doc.alias("id"), F.col("quality").cast("int").alias("question_number"), F.concat(F.lit("claim "), doc).alias("claim"), (F.col("toxic") == 0).alias("is_accurate"))
    table(spark, d, "labels").groupBy((F.col("doc_id") % 16).alias("file")).agg(F.collect_list(claim).alias("claims")).write.partitionBy("file").json(folder)
    return tables.load_labels(spark, folder).select("id", "question_number", "is_accurate", "claim")


@query()
def v12_caption_words(spark, d):
    """Three lines a page, words in a row with boxes of their length; captions are the fourth line, whole, cut, by number and by keywords."""
    lines, n = fx.lines(spark, d), F.col("doc_id") % 4
    box = lambda w, k, y: F.struct(w.alias("text"), (k * 10).cast("double").alias("x0"), y.alias("y0"), (k * 10 + F.length(w)).cast("double").alias("x1"), (y + 10).alias("y1"))
    of_line = lambda t, i: F.transform(F.filter(F.split(t, " "), lambda w: w != ""), lambda w, k: box(w, k, (i * 12).cast("double")))
    texts = fx.documents(spark, d).where("text is not null").select("doc_id", F.split("text", "\n").alias("lines"))
    third = F.floor((F.size("lines") - 1) / 3)
    cut = texts.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), third), lambda p: F.slice("lines", (p * 3 + 1).cast("int"), F.lit(3)))).alias("page", "lines"))
    pages = cut.select("doc_id", F.col("page").cast("long").alias("page"), F.flatten(F.transform("lines", of_line)).alias("words"))
    caption = F.when(n == 0, F.col("text")).when(n == 1, F.concat(F.substring("text", 1, 12), F.lit("zzz"))).otherwise("zz")
    keys = F.when(n == 3, F.slice(F.split("text", " "), 1, 3)).otherwise(F.array().cast("array<string>"))
    captions = lines.where("line_no = 3").select("doc_id", F.col("doc_id").alias("caption_id"), (F.col("doc_id") % 2).alias("page"), caption.alias("caption"), F.when(n == 2, F.col("doc_id") % 3).alias("number"), keys.alias("keywords"))
    return layout.locate_captions(captions, pages)


@query()
def x16_x17_layout(spark, d):
    """The first lines of all documents as boxes of a first page, of kinds by turns, with a line of names in some."""
    names = F.lit("**Jane Doe**, John B. Smith")
    n = F.col("doc_id") % 5
    lines = fx.lines(spark, d).where("line_no < 4").select("doc_id", F.col("line_no").alias("k"), F.when((F.col("line_no") == 1) & (n < 3), names).otherwise(F.col("text")).alias("raw"))
    end = F.sum(F.length("raw") + 1).over(Window.partitionBy("doc_id").orderBy("k"))
    placed = lines.withColumn("pos_end", (end - 1).cast("int")).withColumn("pos_start", F.col("pos_end") - F.length("raw"))
    kind = F.when((F.col("k") == 0) & (n == 1), "title").when((F.col("k") == 0) & (n == 2), "section-header").otherwise("text")
    top = (F.col("k") * 20).cast("double")
    boxes = placed.select("doc_id", F.lit(1).alias("page"), (10 - F.col("k")).cast("int").alias("box_idx"), kind.alias("kind"), "pos_start", "pos_end", F.lit(0.0).alias("x0"), top.alias("y0"), F.lit(100.0).alias("x1"), (top + 10).alias("y1"))
    pages = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "raw"))), lambda x: x["raw"]), "\n").alias("text")).select("doc_id", F.lit(1).alias("page"), "text")
    docs = fx.documents(spark, d).select("doc_id", "text", F.when(n == 0, F.concat(F.lit("Title of file "), F.col("doc_id").cast("string"))).alias("meta_title"), F.lit(None).cast("string").alias("meta_author"))
    return layout.titles_and_authors(docs, layout.reading_order(boxes), pages)
