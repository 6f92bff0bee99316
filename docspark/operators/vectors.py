"""Exact search over vectors with bounds.

Vectors lie in cells with their distance to the cell's centre.  For a query q, a centre c and a vector x of its cell, q x = q c + q (x - c) is at most q c + |q| |x - c|, and with unit
vectors the angle between q and x is at least that between q and c less that between c and x; so a cell's radius bounds the scores that it can hold.  Each query first meets its best cells, as many as hold ``k`` vectors; the k-th score found there is a floor, and of the other cells only those meet it whose bound
reaches the floor.  So the rows are those of a full comparison, ties included, and ``search_share`` tells how much of one was needed.

A cell's queries and vectors meet in blocks of bounded size, one matrix product each, that keep the best ``k`` of each query.  Neither side is broadcast or collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.text import confidence, let
from docspark.operators.cells import BLOCK, Cells, largest, mapped, matrix
from docspark.sources.scratch import kept

#: Scores are rounded to so many places; a bound must be above by ``SLACK`` to stand for a rounded score.
PLACES, SLACK = 6, 1e-6
#: Blocks of vectors up to which all are compared: an index would cost more than it saves.
FEW_BLOCKS = 16

FOUND = "query_id long, paper_id long, vec_id long, score double"


def normalised(v: Column) -> Column:
    """Unit length in double precision; a zero vector stays."""
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    divided = lambda a, n: F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))
    return let(v, lambda a: let(norm(a), lambda n: divided(a, n)))


def _side(df: DataFrame, columns: dict[str, str], key: str, *by: str) -> DataFrame:
    """Blocks of rows: ``by``, an array for each column, and ``flat``, the vectors one after the other."""
    counts = kept(df.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("pieces")))
    dealt = (df.join(counts, list(by)) if by else df.crossJoin(counts)).withColumn("piece", F.pmod(F.xxhash64(key), F.greatest("pieces", F.lit(1))).cast("int"))
    rows = dealt.groupBy(*by, "piece").agg(F.collect_list(F.struct(*[F.col(c).alias(n) for n, c in columns.items()], F.col("vector").alias("v"))).alias("rows"))
    field = lambda name: F.transform("rows", lambda r: r[name])
    return rows.select(*by, *[field(n).alias(n) for n in columns], F.flatten(field("v")).alias("flat"))


def _numbers(column: pa.Array, row: int) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and rounded score of the best ``k`` of each row, ties to the lower id: only scores that can be among them once rounded are rounded and sorted."""
    if scores.shape[1] > k and np.isfinite(scores.sum()):  # else all are sorted, with what is no number last
        floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, at = np.nonzero(scores >= floor[:, None] - 2 * SLACK)
    else:
        row, at = np.divmod(np.arange(scores.size), max(scores.shape[1], 1))
    score = np.round(scores[row, at], PLACES)
    order = np.lexsort((ids[at], -score, row))
    row, at, score = row[order], at[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], at[place < k], score[place < k]


def _products(pairs: DataFrame, k: int, *, unit: bool | None = None, per_paper: bool = False) -> DataFrame:
    """The best ``k`` of each query (and paper) in each pair of blocks: query_ids, query_flat, and if bounds hold (``unit``: those of unit vectors) near, norms and floors; vec_ids, papers, flat, far."""

    def of(batch: pa.RecordBatch) -> dict:
        out: dict[str, list[np.ndarray]] = {"query_id": [], "paper_id": [], "vec_id": [], "score": []}
        column = lambda name, row: _numbers(batch.column(name), row)
        for row in range(batch.num_rows):
            queries, ids, papers = column("query_ids", row), column("vec_ids", row), column("papers", row)
            q, v = (column(c, row).astype(np.float64, copy=False).reshape(n, -1) for c, n in (("query_flat", len(queries)), ("flat", len(ids))))
            if unit is not None:
                floors = column("floors", row)
                meets = largest(unit, column("near", row), column("norms", row), batch.column("far")[row].as_py()) + SLACK >= floors
                queries, q, floors = queries[meets], q[meets], floors[meets]
            scores = q @ v.T
            for group in [np.flatnonzero(papers == p) for p in np.unique(papers)] if per_paper else [None]:
                s, i, p = (scores, ids, papers) if group is None else (scores[:, group], ids[group], papers[group])
                row, at, score = _best(s, i, k)
                if unit is not None:
                    reach = score >= floors[row]  # below the floor nothing is among the best
                    row, at, score = row[reach], at[reach], score[reach]
                out["query_id"].append(queries[row])
                out["paper_id"].append(p[at])
                out["vec_id"].append(i[at])
                out["score"].append(score)
        return {name: np.concatenate(x) for name, x in out.items()}

    # A row is a pair of blocks.
    return mapped(pairs, FOUND, of, most=4)


def _first_cells(near: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """For each query a mask of its nearest cells, as many as hold ``k`` vectors."""
    order = np.argsort(-near, axis=1, kind="stable")
    before = np.cumsum(sizes[order], axis=1) - sizes[order]
    mask = np.zeros(near.shape, bool)
    np.put_along_axis(mask, order, before < k, axis=1)
    return mask & (sizes > 0)


def _asked(queries: DataFrame, cells: Cells, k: int, *, first: bool) -> DataFrame:
    """query_id, cell, near, norm, floor, vector of each query and each cell that it meets: first the nearest ones, then those whose bound reaches its floor."""
    centres, sizes, radii, unit = cells.centres, cells.sizes, cells.radii, cells.unit

    def of(batch: pa.RecordBatch) -> dict:
        q = matrix(batch.column("vector"))
        near, norm = q @ centres.T, np.sqrt((q**2).sum(1))
        chosen = _first_cells(near, sizes, k)
        floor = np.full(len(q), -np.inf) if first else batch.column("floor").to_numpy(zero_copy_only=False)
        if not first:
            chosen = ~chosen & (sizes > 0) & (largest(unit, near, norm[:, None], radii) + SLACK >= floor[:, None])
        row, cell = np.nonzero(chosen)
        return {"query_id": batch.column("query_id").take(pa.array(row)), "cell": cell, "near": near[row, cell], "norm": norm[row], "floor": floor[row], "vector": batch.column("vector").take(pa.array(row))}

    return mapped(queries, f"query_id long, cell int, near double, norm double, floor double, vector {queries.schema['vector'].dataType.simpleString()}", of)


def _ready(df: DataFrame, *columns: str) -> DataFrame:
    """The rows with a vector, computed once: what made the vectors may be dear.  Single precision stays as it is on disk and is widened where products are made."""
    single = df.schema["vector"].dataType.simpleString() == "array<float>"
    return kept(df.where("vector is not null").select(*columns, F.col("vector").cast("array<float>" if single else "array<double>").alias("vector")))


def _search(queries: DataFrame, vectors: DataFrame, k: int) -> tuple[DataFrame, list[DataFrame], Cells]:
    """What each query's best ``k`` are among, and the cells that each query met in either round."""
    cells = Cells.fit(vectors, id_col="vec_id")
    if not cells.sizes.sum():
        return queries.sparkSession.createDataFrame([], FOUND), [], cells
    blocks = kept(cells.blocks({"vec_ids": "vec_id", "papers": "paper_id"}, id_col="vec_id"))
    columns = {"query_ids": "query_id", "near": "near", "norms": "norm", "floors": "floor"}

    def met(asked: DataFrame) -> DataFrame:
        return kept(_products(_side(asked, columns, "query_id", "cell").withColumnRenamed("flat", "query_flat").join(blocks, "cell"), k, unit=cells.unit))

    asked = [kept(_asked(queries, cells, k, first=True))]
    found = met(asked[0])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    floors = found.withColumn("place", place).where(F.col("place") == k).select("query_id", F.col("score").alias("floor"))
    floored = queries.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    asked.append(kept(_asked(floored, cells, k, first=False)))
    return found.unionByName(met(asked[1])), asked, cells


def best_pairs(queries: DataFrame, vectors: DataFrame, k: int, *, per_paper: bool = False) -> DataFrame:
    """query_id, paper_id, vec_id, score (6 places): the best ``k`` of each query, or of each query and paper, by score, then vec_id.

    ``queries`` has query_id and vector, ``vectors`` has vec_id (unique), paper_id and vector, all of one length; rows without a vector are left out.  Each query and paper have a row for any k, so
    ``per_paper`` compares all blocks with all blocks, and so is a table of few blocks; the rest is searched by bounds.
    """
    queries, vectors = _ready(queries, "query_id"), _ready(vectors, "vec_id", "paper_id")
    if per_paper or vectors.limit(FEW_BLOCKS * BLOCK + 1).count() <= FEW_BLOCKS * BLOCK:
        sides = [_side(queries, {"query_ids": "query_id"}, "query_id").withColumnRenamed("flat", "query_flat"), _side(vectors, {"vec_ids": "vec_id", "papers": "paper_id"}, "vec_id")]
        found = _products(sides[0].crossJoin(sides[1]), k, per_paper=per_paper)
    else:
        found, _, _ = _search(queries, vectors, k)
    w = Window.partitionBy("query_id", *["paper_id"] * per_paper).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_share(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, cells, cells_met, vectors, vectors_met: how much of a full comparison the search of each query needs."""
    _, asked, cells = _search(_ready(queries, "query_id"), _ready(vectors, "vec_id", "paper_id"), k)
    sizes = queries.sparkSession.createDataFrame([(c, int(n)) for c, n in enumerate(cells.sizes)], "cell int, n long")
    met = [a.select("query_id", "cell") for a in asked]
    of = met[0].unionByName(met[1]).join(F.broadcast(sizes), "cell").groupBy("query_id").agg(F.count("*").alias("cells_met"), F.sum("n").alias("vectors_met"))
    total = [F.lit(int((cells.sizes > 0).sum())).cast("long").alias("cells"), F.lit(int(cells.sizes.sum())).cast("long").alias("vectors")]
    return of.select("query_id", total[0], "cells_met", total[1], "vectors_met")


def best_source(claims: DataFrame, sources: DataFrame, *, high: float = 0.85, medium: float = 0.65) -> DataFrame:
    """Best source of each claim with its confidence; claims without any source are low with score 0."""
    best = best_pairs(claims, sources, 1).select("query_id", "vec_id", "paper_id", "score")
    joined = claims.select("query_id").join(best, "query_id", "left")
    score = F.coalesce("score", F.lit(0.0))
    return joined.select("query_id", "vec_id", "paper_id", score.alias("score"), confidence(score, high, medium).alias("confidence"), ((score >= medium) & (score < high)).alias("needs_rerank"))


def topk_per_paper(queries: DataFrame, vectors: DataFrame, k: int, *, papers: DataFrame | None = None, exact_per_paper: bool = False) -> DataFrame:
    """Best ``k`` chunks of each paper for every query. Unless ``exact_per_paper``, a global cut of 2 k times the number of papers comes first."""
    if exact_per_paper:
        return best_pairs(queries, vectors, k, per_paper=True)
    n = (papers or vectors.select("paper_id").distinct()).count()
    cut = best_pairs(queries, vectors, k * n * 2).drop("rank")
    if papers is not None:
        cut = cut.join(papers.select("paper_id").distinct(), "paper_id", "left_semi")
    w = Window.partitionBy("query_id", "paper_id").orderBy(F.desc("score"), "vec_id")
    return cut.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_stats(vectors: DataFrame, dims: int, capacity: int = 200_000) -> DataFrame:
    n = F.count("*")
    return vectors.agg(n.alias("total"), F.lit(capacity).cast("long").alias("maximum"), F.round(n / capacity * 100, 2).alias("utilisation"), F.round(n * dims * 4 / 1048576, 2).alias("memory_mb"))
