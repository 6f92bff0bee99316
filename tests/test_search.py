"""Search with bounds and density clusters against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.operators import cells, clusters, graph, vectors

SCHEMA = "vec_id long, paper_id long, vector array<double>"


def clustered(seed, n=300, dims=8, heaps=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(heaps, dims))
    x = centres[rng.integers(0, heaps, n)] + rng.normal(size=(n, dims)) * rng.choice([0.02, 0.3], n)[:, None]
    x[: n // 5] = x[0]  # a group of copies
    x[n // 5 : n // 4] = np.round(x[n // 5 : n // 4])  # ties
    return x


def unit(x):
    return x / np.where((n := np.sqrt((x**2).sum(1, keepdims=True))) == 0, 1, n)


def table(spark, x):
    return spark.createDataFrame([(int(i) * 3, int(i) % 4, [float(c) for c in v]) for i, v in enumerate(x)], SCHEMA)


@pytest.mark.parametrize(("seed", "k", "whole", "few"), [(0, 1, True, 0), (1, 5, True, 0), (2, 40, False, 0), (3, 1000, True, 0), (1, 5, True, 100)])
def test_search_equals_a_full_comparison(spark, monkeypatch, seed, k, whole, few):
    monkeypatch.setattr(cells, "BLOCK", 16)
    monkeypatch.setattr(vectors, "FEW_BLOCKS", few)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    x = clustered(seed)
    x = unit(x) if whole else x
    asked = np.vstack([x[::17], clustered(seed + 9, n=6), np.zeros((1, x.shape[1]))])
    queries = table(spark, asked).select(F.col("vec_id").alias("query_id"), "vector").union(spark.createDataFrame([(-1, None)], "query_id long, vector array<double>"))
    got = vectors.best_pairs(queries, table(spark, x), k).collect()
    s = np.round(asked @ x.T, 6)
    want = set()
    for q in range(len(asked)):
        for rank, i in enumerate(np.lexsort((np.arange(len(x)), -s[q]))[:k]):
            want.add((q * 3, int(i) * 3, float(s[q, i]), rank + 1))
    assert {(r["query_id"], r["vec_id"], r["score"], r["rank"]) for r in got} == want and len(got) == len(want)


def test_blocks_that_bounds_let_through_give_no_row_below_the_floor(spark, monkeypatch):
    """Random directions, of which no bound skips any: what is written is near the best of each query, not the best of each query and block; single precision stays."""
    monkeypatch.setattr(cells, "BLOCK", 16)
    monkeypatch.setattr(vectors, "FEW_BLOCKS", 0)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    written, real = [], vectors.kept
    monkeypatch.setattr(vectors, "kept", lambda df: written.append(made := real(df)) or made)
    x = unit(np.random.default_rng(2).normal(size=(900, 24))).astype(np.float32)
    of = spark.createDataFrame([(i, i % 4, v.tolist()) for i, v in enumerate(x)], "vec_id long, paper_id long, vector array<float>")
    queries = of.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in vectors.best_pairs(queries, of, 5).collect()}
    s = np.round(x.astype(float) @ x.astype(float).T, 6)
    assert got == {(q, n + 1): int(i) for q in range(0, 900, 100) for n, i in enumerate(np.lexsort((np.arange(900), -s[q]))[:5])}
    second = [df.count() for df in written if df.columns == ["query_id", "paper_id", "vec_id", "score"]][1]
    assert second < 9 * 100  # 9 queries, some 55 blocks, 5 of each before
    assert {df.schema["vector"].dataType.simpleString() for df in written if "vector" in df.columns} == {"array<float>"}


def test_bounds_skip_most_of_a_clustered_table(spark):
    x = unit(clustered(4, n=1500, heaps=20))
    queries = table(spark, x[::100]).select(F.col("vec_id").alias("query_id"), "vector")
    share = vectors.search_share(queries, table(spark, x), 3).collect()
    assert len(share) == 15 and all(r["vectors"] == 1500 for r in share)
    assert sum(r["vectors_met"] for r in share) < 0.5 * sum(r["vectors"] for r in share)


def test_search_of_nothing(spark):
    none = table(spark, np.zeros((0, 4)))
    queries = table(spark, np.ones((2, 4))).select(F.col("vec_id").alias("query_id"), "vector")
    assert vectors.best_pairs(queries, none, 3).collect() == []
    for few in (0, 16):
        vectors.FEW_BLOCKS, before = few, vectors.FEW_BLOCKS
        assert vectors.best_pairs(queries, none, 3).collect() == []
        vectors.FEW_BLOCKS = before
    assert vectors.best_pairs(queries.limit(0), table(spark, np.ones((2, 4))), 3).collect() == []
    best = vectors.best_source(queries, none).collect()
    assert [(r["score"], r["confidence"]) for r in best] == [(0.0, "low")] * 2


def test_best_of_each_paper(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    x = unit(clustered(6, n=120))
    queries = table(spark, x[:5]).select(F.col("vec_id").alias("query_id"), "vector")
    got = {(r["query_id"], r["paper_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vectors.best_pairs(queries, table(spark, x), 2, per_paper=True).collect()}
    s = np.round(x[:5] @ x.T, 6)
    for q in range(5):
        for p in range(4):
            own = np.arange(p, 120, 4)
            for rank, i in enumerate(own[np.lexsort((own, -s[q, own]))[:2]]):
                assert got[q * 3, p, rank + 1] == (int(i) * 3, float(s[q, i]))


def brute_clusters(ids, x, eps, min_pts):
    x = unit(np.asarray(x, float))
    some = (x != 0).any(1)
    s = np.round(x @ x.T, 6)
    near = (s >= round(1 - eps, 6)) & some[:, None] & some[None]
    np.fill_diagonal(near, some)
    core = near.sum(1) >= min_pts
    cluster = {i: None for i in range(len(x))}
    for i in sorted(np.flatnonzero(core), key=lambda i: ids[i]):
        if cluster[i] is None:
            todo = [i]
            while todo:
                j = todo.pop()
                if cluster[j] is None:
                    cluster[j] = ids[i]
                    todo += np.flatnonzero(near[j] & core).tolist()
    out = []
    for i in range(len(x)):
        at = np.flatnonzero(near[i] & core)
        kind = "core" if core[i] else "border" if len(at) else "noise"
        best = min(at, key=lambda j: (-s[i, j], ids[j])) if kind == "border" else i
        out.append((ids[i], cluster[best], kind))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "eps", "min_pts", "block"), [(0, 0.05, 4, 16), (1, 0.2, 5, 1024), (2, 0.01, 3, 16), (3, 0.0, 4, 16), (4, 0.6, 30, 64), (5, 0.05, 1, 16)])
def test_density_clusters_equal_brute_force(spark, monkeypatch, seed, eps, min_pts, block):
    monkeypatch.setattr(clusters, "BLOCK", block)
    x = clustered(seed, n=260, dims=5)
    x[7] = 0
    ids = random.Random(seed).sample(range(1000), len(x))
    rows = [(i, [float(c) for c in v], "clash") for i, v in zip(ids, x, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>, node string").repartition(3)
    got = sorted(map(tuple, clusters.topic_clusters(df, eps=eps, min_pts=min_pts).collect()), key=str)
    assert got == brute_clusters(ids, x, eps, min_pts)


@pytest.mark.parametrize(("seed", "sample", "slice_", "eps", "min_pts"), [(0, 20, 40, 0.05, 4), (1, 1, 25, 0.02, 5), (2, 60, 1000, 0.3, 12), (6, 20, 10, 0.008, 3)])
def test_points_move_once_for_a_slice_and_not_for_each_cell_near_them(spark, monkeypatch, seed, sample, slice_, eps, min_pts):
    """The same clusters whatever the sample settles, and no table of more vectors than there are points."""
    monkeypatch.setattr(clusters, "BLOCK", 8)
    monkeypatch.setattr(clusters, "SAMPLE", sample, raising=False)
    monkeypatch.setattr(clusters, "SLICE", slice_, raising=False)
    sizes, real = [], clusters.kept
    monkeypatch.setattr(clusters, "kept", lambda df: sizes.append((made := real(df)).count() * ("vector" in df.columns)) or made)
    x = np.vstack([clustered(seed, n=150, dims=5), np.random.default_rng(seed).normal(1, 0.1, (100, 5))])
    ids = random.Random(seed).sample(range(1000), len(x))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, vector array<double>").repartition(3)
    got = sorted(map(tuple, clusters.topic_clusters(df, eps=eps, min_pts=min_pts).collect()), key=str)
    assert got == brute_clusters(ids, x, eps, min_pts)
    assert max(sizes) <= len(x)


def test_rows_that_are_no_numbers_hide_no_neighbours():
    x = unit(np.random.default_rng(3).normal(1, 0.2, (60, 4)))
    x[5] = np.nan
    found = {(int(a), int(b)) for row, col, _ in clusters._pairs(x, x, 0.97, 0.3, 8) for a, b in zip(row, col, strict=True)}
    assert found == {(int(a), int(b)) for a, b in zip(*np.nonzero(np.round(x @ x.T, 6) >= 0.97), strict=True)}


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "vec_id long, vector array<double>")
    assert sorted(map(tuple, clusters.topic_clusters(df, eps=0.1, min_pts=1).collect())) == [(1, None, "noise"), (2, None, "noise")]
    assert clusters.topic_clusters(df.limit(0), eps=0.1, min_pts=1).collect() == []
    with pytest.raises(ValueError, match="eps"):
        clusters.topic_clusters(df, eps=1.0, min_pts=1)


def test_components_of_chains_rings_and_stars(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(300)] + [(1000 + k, 1000 + (k + 1) % 50) for k in range(50)] + [(2000, 2000 + k) for k in range(1, 80)] + [(5000, 5000)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(301)}, **{1000 + k: 1000 for k in range(50)}, **{2000 + k: 2000 for k in range(80)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_few_rows_are_worked_on_at_a_time(spark):
    """However many Spark puts into a batch, and none is lost."""
    made = cells.mapped(spark.range(0, 1000, 1, 1), "n long, total long", lambda batch: {"n": [batch.num_rows], "total": [sum(batch.column("id").to_pylist())]}).collect()
    assert max(r["n"] for r in made) <= cells.AT_ONCE and sum(r["n"] for r in made) == 1000 and sum(r["total"] for r in made) == 499_500


def test_only_scores_that_can_count_are_sorted(monkeypatch):
    rng = np.random.default_rng(5)
    for shape, k in (((7, 900), 15), ((3, 4), 9), ((0, 5), 2), ((4, 0), 2), ((5, 300), 1)):
        scores = np.round(rng.random(shape), 2) + rng.choice([0, 4e-7, -4e-7], shape)  # ties once rounded
        ids = rng.permutation(shape[1]).astype(np.int64)
        rounded, sizes, real = np.round(scores, vectors.PLACES), [], np.lexsort
        order = np.lexsort((np.broadcast_to(ids, shape), -rounded), axis=1)[:, :k]
        with monkeypatch.context() as m:
            m.setattr(np, "lexsort", lambda keys: sizes.append(len(keys[0])) or real(keys))
            row, at, score = vectors._best(scores, ids, k)
        assert row.tolist() == np.repeat(np.arange(shape[0]), order.shape[1]).tolist() and at.tolist() == order.ravel().tolist()
        assert score.tolist() == np.take_along_axis(rounded, order, 1).ravel().tolist() and (shape[1] < 300 or sum(sizes) < scores.size / 4)
