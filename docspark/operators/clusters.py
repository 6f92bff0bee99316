"""Density clusters of vectors: neighbours are vectors whose cosine distance is at most ``eps``.

A point with at least ``min_pts`` points in its neighbourhood, itself and repeats included, is a core point; core points that are neighbours share a cluster; another point with a core point in its
neighbourhood belongs to the cluster of the nearest one, and the rest is noise.

Equal vectors are one point with a weight.  A sample of stated size comes first: a point whose neighbours in it weigh ``min_pts`` is a core point, and a core point is in the cluster of the sample's core points
that are its neighbours, which settles most of a dense heap.  The sample settles how much is left to compare and nothing else: points that are not known to be core points then meet all points, and core
points outside the largest cluster so far meet all core points.  They meet in groups of a slice of the few and a slice of all, each a range of cells (``cells.py``), and within a group block by block;
blocks whose centres are farther apart than neighbours allow are passed over.  So a vector moves once for each slice of the other side, not for each cell near it.  A group gives weights, fewer than
``min_pts`` neighbours of a point, and edges that span its clusters, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.operators.cells import AT_ONCE, BLOCK, Cells, groups, mapped, matrix
from docspark.operators.graph import components
from docspark.operators.vectors import PLACES, normalised
from docspark.sources.scratch import kept

#: Points of the sample, about; points of a slice, and blocks that some rows meet at a time.
SAMPLE, SLICE, BLOCKS = 1 << 12, 1 << 16, 16


def _points(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Every row with the key of its vector, and the points: node, least id, weight, vector (of unit length) of each key.  Null and zero vectors have no direction and no key."""
    unit = normalised(F.col(vector_col).cast("array<double>"))
    rows = vectors.select(F.col(id_col).alias("id"), unit.alias("vector")).withColumn("some", F.exists("vector", lambda x: x != 0))
    rows = kept(rows.select("id", "vector", F.when(F.col("some"), F.sha2(F.array_join(F.transform("vector", lambda x: x.cast("string")), ","), 256)).alias("key")))
    points = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    return rows.select("id", "key"), kept(kept(points).withColumn("node", F.monotonically_increasing_id()))


def _pairs(x: np.ndarray, y: np.ndarray, least_score: float, reach: float, block: int, other: Callable[[slice, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row of ``x``, row of ``y`` and score of neighbours, some blocks at a time; rows that are like each other should stand together.  ``other`` leaves out rows of ``y`` that some rows of ``x`` need not meet."""
    middle = lambda v: (m := v.mean(0), np.sqrt(((v - m) ** 2).sum(1).max()))
    blocks = [middle(y[k : k + block]) for k in range(0, len(y), block)]
    if not blocks:
        return
    centres, radii = np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])
    for at in range(0, len(x), AT_ONCE):
        part = x[at : at + AT_ONCE]
        centre, radius = middle(part)
        meets = np.flatnonzero(~(np.sqrt(((centres - centre) ** 2).sum(1)) > radius + radii + reach))  # what is no number rules nothing out
        for k in range(0, len(meets), BLOCKS):
            cols = np.concatenate([np.arange(b * block, min((b + 1) * block, len(y))) for b in meets[k : k + BLOCKS]])
            cols = cols if other is None else cols[other(slice(at, at + AT_ONCE), cols)]
            scores = part @ y[cols].T
            row, col = np.nonzero(scores >= least_score - 10.0**-PLACES)  # only scores that can reach it are rounded
            score = np.round(scores[row, col], PLACES)
            near = score >= least_score
            yield at + row[near], cols[col[near]], score[near]


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Joins the classes of ``a`` and ``b``, pair by pair, in ``root`` (the least of each one's class); the pairs of classes that this took."""
    p, q = root[a], root[b]
    made = []
    for code in np.unique((np.minimum(p, q) * len(root) + np.maximum(p, q))[p != q]).tolist():
        u, v = sorted((int(root[code // len(root)]), int(root[code % len(root)])))
        if u != v:
            made.append((u, v))
            root[root == v] = u
    return made


def _sampled(points: DataFrame, count: int, least_score: float, reach: float, min_pts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, weights and vectors of the sample, and for the points in it that it shows to be core points the least node of their cluster in it, else -1."""
    rows = points.where(F.pmod(F.xxhash64("node"), F.lit(max(1, -(-count // SAMPLE)))) == 0).orderBy("cell", "node").select("node", "weight", "vector").collect()
    node, weight = (np.array([r[c] for r in rows], np.int64) for c in ("node", "weight"))
    x = np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 0))
    n, root = np.zeros(len(x), np.int64), np.arange(len(x))
    for row, col, _ in _pairs(x, x, least_score, reach, BLOCK):
        np.add.at(n, row, weight[col])
    core = n >= min_pts
    for row, col, _ in _pairs(x, x, least_score, reach, BLOCK):
        both = core[row] & core[col]
        _joined(root, row[both], col[both])
    return node, weight, x, np.where(core, node[root] if len(node) else -1, -1)


def _settled(members: DataFrame, sample: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], least_score: float, min_pts: int) -> DataFrame:
    """node, least, weight, cell, vector, sure (a core point by its neighbours in the sample) and touched (clusters of the sample's core points that are its neighbours) of every point."""
    nodes, weights, vectors, clusters = sample
    known = {n: k for k, n in enumerate(nodes.tolist())}

    def of(batch: pa.RecordBatch) -> dict:
        x, node, weight = matrix(batch.column("vector")), batch.column("node").to_numpy(), batch.column("weight").to_numpy()
        scores = x @ vectors.T if len(nodes) else np.zeros((len(x), 0))
        row, col = np.nonzero(scores >= least_score - 10.0**-PLACES)
        near = np.round(scores[row, col], PLACES) >= least_score
        row, col = row[near], col[near]
        n = np.bincount(row, weights[col], len(x)) + [0 if k in known else w for k, w in zip(node.tolist(), weight.tolist(), strict=True)]  # a point is its own neighbour
        touched: list[list[int]] = [[] for _ in range(len(x))]
        some = clusters[col] >= 0
        for r, c in np.unique(np.stack([row[some], clusters[col[some]]], 1), axis=0).tolist():
            touched[r].append(c)
        return {"sure": n >= min_pts, "touched": touched, **{c: batch.column(c) for c in ("node", "least", "weight", "cell", "vector")}}

    return mapped(members, "node long, least long, weight long, cell int, vector array<double>, sure boolean, touched array<long>", of)


def _sliced(df: DataFrame, most: int) -> tuple[DataFrame, int]:
    """``df`` with the number of its slice, and how many slices there are: ranges of cells of at most about ``most`` rows, and at least as many as cores if blocks are; a cell that is cut is dealt by hash."""
    sizes = {r["cell"]: r["n"] for r in df.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each centre
    n, starts = 0, []
    for cell, size in sorted(sizes.items()):
        starts.append((cell, n, size))
        n += size
    slices = max(-(-n // most), min(df.sparkSession.sparkContext.defaultParallelism, -(-n // BLOCK)), 1)
    at = df.sparkSession.createDataFrame(starts, "cell int, before long, size long")
    place = F.col("before") + F.pmod(F.xxhash64("node"), F.col("size"))
    return df.join(F.broadcast(at), "cell").withColumn("slice", F.floor(place * slices / max(n, 1)).cast("int")).drop("before", "size"), slices


def _met(few: DataFrame, every: DataFrame, columns: list[str], schema: str, of: Callable[[pa.Table, pa.Table], pa.RecordBatch | None]) -> DataFrame:
    """What ``of`` makes of each slice of the few and each slice of all."""
    (few, a), (every, b) = _sliced(few, SLICE), _sliced(every, SLICE)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = few.withColumn("other", each(b)).select((F.col("slice") * b + F.col("other")).cast("long").alias("group"), F.lit(0).alias("side"), *columns)
    right = every.withColumn("other", each(a)).select((F.col("other") * b + F.col("slice")).cast("long").alias("group"), F.lit(1).alias("side"), *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            table = table.combine_chunks()
            at = int(np.searchsorted(table.column("side").to_numpy(), 1))
            if 0 < at < table.num_rows and (made := of(table.slice(0, at), table.slice(at))) is not None:
                yield made

    return left.unionByName(right).repartition("group").sortWithinPartitions("group", "side", *columns[:2]).mapInArrow(run, schema)


def _matrix(table: pa.Table) -> np.ndarray:
    return matrix(column.combine_chunks() if isinstance(column := table.column("vector"), pa.ChunkedArray) else column)


def _counted(few: DataFrame, every: DataFrame, least_score: float, reach: float, min_pts: int) -> DataFrame:
    """node, n (the weight of its neighbours) and near (their node, score and least id, if they weigh less than ``min_pts``) of the few."""
    block = BLOCK

    def of(left: pa.Table, right: pa.Table) -> pa.RecordBatch:
        node, weight, least = (right.column(c).to_numpy() for c in ("node", "weight", "least"))
        n, found = np.zeros(left.num_rows, np.int64), []
        for row, col, score in _pairs(_matrix(left), _matrix(right), least_score, reach, block):
            np.add.at(n, row, weight[col])
            rare = n[row] < min_pts
            found.append((row[rare], col[rare], score[rare]))
        near: list[list[dict]] = [[] for _ in range(left.num_rows)]
        for row, col, score in found:
            rare = n[row] < min_pts
            for r, c, s in zip(row[rare].tolist(), col[rare].tolist(), score[rare].tolist(), strict=True):
                near[r].append({"b": node[c], "score": s, "least": least[c]})
        some = np.flatnonzero(n > 0)
        return pa.RecordBatch.from_arrays([left.column("node").to_numpy()[some], pa.array(n[some]), pa.array([near[k] for k in some], pa.list_(pa.struct([("b", pa.int64()), ("score", pa.float64()), ("least", pa.int64())])))], names=["node", "n", "near"])

    made = _met(few, every, ["cell", "node", "least", "weight", "vector"], "node long, n long, near array<struct<b:long,score:double,least:long>>", of)
    return made.groupBy("node").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("near")).alias("near"))


def _links(few: DataFrame, every: DataFrame, least_score: float, reach: float) -> DataFrame:
    """a, b: clusters that neighbours among the few and all core points join, edges that span them in each group."""
    block = BLOCK

    def of(left: pa.Table, right: pa.Table) -> pa.RecordBatch | None:
        names, code = np.unique(np.concatenate([left.column("cluster").to_numpy(), right.column("cluster").to_numpy()]), return_inverse=True)
        a, b, root, edges = code[: left.num_rows], code[left.num_rows :], np.arange(len(names)), []

        def other(rows: slice, cols: np.ndarray) -> np.ndarray:
            own = np.unique(root[a[rows]])
            return root[b[cols]] != own[0] if len(own) == 1 else np.ones(len(cols), bool)

        for row, col, _ in _pairs(_matrix(left), _matrix(right), least_score, reach, block, other):
            edges += _joined(root, a[row], b[col])
        return pa.RecordBatch.from_arrays([pa.array(names[[e[k] for e in edges]]) for k in (0, 1)], names=["a", "b"]) if edges else None

    return _met(few, every, ["cluster", "cell", "node", "vector"], "a long, b long", of)


def topic_clusters(vectors: DataFrame, *, eps: float, min_pts: int, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """id_col, cluster (the least id of its core points; null for noise) and kind (core, border, noise) of every row.

    Scores are rounded to six places before they are compared with 1 - ``eps``.  A border point with two nearest core points goes to that of the lower id.  Null and zero vectors are noise, rows with
    equal vectors share their cluster, an empty table gives an empty one; vectors have one length and ids are numbers.  0 <= eps < 1.
    """
    if not 0 <= eps < 1:
        raise ValueError("eps is a cosine distance from 0 up to below 1")
    rows, points = _points(vectors, id_col, vector_col)
    cells = Cells.fit(points.select("node", "least", "weight", "vector"), id_col="node")
    least_score = round(1 - eps, PLACES)
    reach = math.sqrt(2 * (1 - least_score) + 2 * 10.0**-PLACES) + 1e-9  # the largest distance of neighbours, with what rounding lets in
    if not (count := int(cells.sizes.sum())):
        return rows.select(F.col("id").alias(id_col), F.lit(None).cast("long").alias("cluster"), F.lit("noise").alias("kind"))
    settled = kept(_settled(cells.members, _sampled(cells.members, count, least_score, reach, min_pts), least_score, min_pts))
    counted = kept(_counted(settled.where("not sure"), settled, least_score, reach, min_pts))
    core = settled.where("sure").unionByName(settled.join(counted.where(F.col("n") >= min_pts).select("node"), "node", "left_semi"))
    core = kept(core.select("node", "cell", "vector", "least", F.coalesce(F.array_min("touched"), "node").alias("first"), "touched"))
    sampled = components(core.select(F.col("first").alias("a"), F.explode("touched").alias("b")).where("a <> b").distinct())
    core = kept(core.drop("touched").join(sampled.withColumnRenamed("node", "first"), "first", "left").select("node", "cell", "vector", "least", F.coalesce("root", "first").alias("cluster")))
    largest = [r["cluster"] for r in core.groupBy("cluster").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster").limit(1).collect()]
    links = kept(_links(core.where(~F.col("cluster").isin(largest)), core, least_score, reach))
    of_core = core.select("node", "least", "cluster").join(components(links).withColumnRenamed("node", "cluster"), "cluster", "left").select("node", "least", F.coalesce("root", "cluster").alias("root"))
    named = of_core.groupBy("root").agg(F.min("least").alias("cluster"))
    of_core = kept(of_core.join(named, "root").select("node", "cluster"))
    near = counted.where(F.col("n") < min_pts).select(F.col("node").alias("a"), F.explode("near").alias("at")).select("a", F.col("at.b").alias("node"), "at.score", "at.least")
    of_border = near.join(of_core, "node").groupBy(F.col("a").alias("node")).agg(F.min_by("cluster", F.struct((-F.col("score")).alias("s"), "least")).alias("cluster"))
    of_point = of_core.withColumn("kind", F.lit("core")).unionByName(of_border.withColumn("kind", F.lit("border"))).join(points.select("node", "key"), "node").select("key", "cluster", "kind")
    return rows.join(of_point, "key", "left").select(F.col("id").alias(id_col), "cluster", F.coalesce("kind", F.lit("noise")).alias("kind"))
