"""Queries over vectors of whole documents: exact search with bounds, and density clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators import clusters, vectors
from docspark.plans.fixtures import documents
from docspark.plans.registry import query

#: A document's vector counts these letters, so that the twins can make it, too.
LETTERS = "abcdefghijklmnopqrstuvwxyzäéíóöüñç"
EPS, MIN_PTS, NEAREST = 0.004, 8, 5

LETTERS_SQL = (
    "letters AS (SELECT doc_id, list_transform(string_split('" + LETTERS + "', ''), lambda c: (length(t) - length(replace(t, c, '')))::DOUBLE) AS n FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)), "
    "unit AS MATERIALIZED (SELECT doc_id, list_transform(n, lambda x: x / CASE WHEN list_sum(list_transform(n, lambda y: y * y)) = 0 THEN 1 ELSE sqrt(list_sum(list_transform(n, lambda y: y * y))) END) AS v, list_sum(n) > 0 AS some FROM letters)"
)


def letter_vectors(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, vector of unit length; zero for texts without letters."""
    low = F.lower(F.coalesce("text", F.lit("")))
    counts = F.array(*[(F.length("low") - F.length(F.replace("low", F.lit(c), F.lit("")))).cast("double") for c in LETTERS])
    return documents(spark, d).select("doc_id", low.alias("low")).select("doc_id", vectors.normalised(counts).alias("vector"))


def _nearest(spark, d):
    every = letter_vectors(spark, d)
    asked = every.where(F.col("doc_id") % 100 == 0).withColumnRenamed("doc_id", "query_id")
    return asked, every.select(F.col("doc_id").alias("vec_id"), F.lit(0).cast("long").alias("paper_id"), "vector")


@query(f"""WITH {LETTERS_SQL}, pairs AS (SELECT a.doc_id AS query_id, b.doc_id AS vec_id, round(list_inner_product(a.v, b.v), 6) AS score FROM unit a, unit b WHERE a.doc_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) SELECT * FROM r WHERE rank <= {NEAREST}""")
def v04_nearest_documents(spark, d):
    """Documents whose id is divisible by 100, against all documents."""
    asked, every = _nearest(spark, d)
    return vectors.best_pairs(asked, every, NEAREST).select("query_id", "vec_id", "score", "rank")


@query()
def v04_search_share(spark, d):
    """How much of a full comparison the same search needs."""
    return vectors.search_share(*_nearest(spark, d), NEAREST)


@query(f"""WITH RECURSIVE {LETTERS_SQL}, n AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, round(list_inner_product(a.v, b.v), 6) AS s FROM unit a, unit b WHERE a.some AND b.some AND round(list_inner_product(a.v, b.v), 6) >= {1 - EPS}),
c AS MATERIALIZED (SELECT a FROM n GROUP BY a HAVING count(*) >= {MIN_PTS}), e AS MATERIALIZED (SELECT a, b FROM n WHERE a IN (FROM c) AND b IN (FROM c)),
r(node, root) AS (SELECT a, a FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b), k AS (SELECT node, min(root) AS cluster FROM r GROUP BY node),
g AS (SELECT n.a, arg_min(k.cluster, struct_pack(s := -n.s, b := n.b)) AS cluster FROM n JOIN k ON k.node = n.b WHERE n.a NOT IN (FROM c) GROUP BY n.a)
SELECT doc_id, coalesce(k.cluster, g.cluster) AS cluster, CASE WHEN k.cluster IS NOT NULL THEN 'core' WHEN g.cluster IS NOT NULL THEN 'border' ELSE 'noise' END AS kind FROM unit LEFT JOIN k ON k.node = doc_id LEFT JOIN g ON g.a = doc_id""")
def n11_topic_clusters(spark, d):
    return clusters.topic_clusters(letter_vectors(spark, d), eps=EPS, min_pts=MIN_PTS, id_col="doc_id")
