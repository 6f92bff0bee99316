"""Keywords by maximal marginal relevance against a plain greedy search."""

import collections
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docspark.operators import flows, keywords


def plain(text, candidates, most, diversity):
    relevance = np.round(candidates @ text, 6)
    chosen = []
    while len(chosen) < min(most, len(candidates)):
        best = None
        for i in range(len(candidates)):
            if i not in chosen:
                near = max((np.round(candidates[i] @ candidates[j], 6) for j in chosen), default=None)
                value = relevance[i] if near is None else round((1 - diversity) * relevance[i] - diversity * near, 9)
                if best is None or value > best[0]:
                    best = (value, i)
        chosen.append(best[1])
    return chosen


@pytest.mark.parametrize("diversity", [0.0, 0.5, 0.9])
def test_lazy_choice_equals_a_plain_one(diversity):
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 60):
        x = rng.integers(-2, 5, (n, 4)).astype(float)
        x /= np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1)
        text = rng.random(4)
        assert keywords.spread_out(text, x, 15, diversity) == plain(text, x, 15, diversity)


def test_keywords_of_documents(spark):
    rng = random.Random(4)
    words = [f"term{k}" for k in range(40)] + ["the", "and", "of", "study", "12", "ab", "x", "été"]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 12, 60, 200)] + [None, "", "the and of " * 20, "alpha " * 30]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, keyword string")
    got = keywords.mmr_keywords(docs, top_n=5, stop_words=["the", "and", "of"]).collect()
    want = set()
    for k, text in enumerate(texts):
        if text is None or len(text.strip()) < 50:
            continue
        ws = [w for w in text.lower().split() if len(w) > 1 and w not in ("the", "and", "of")]
        grams = sorted({" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)})
        if not grams:
            continue
        v = np.asarray(keywords.hashed_texts(pd.Series([text, *grams])), float)
        scored = sorted((-round(float(v[i + 1] @ v[0]), 4), grams[i]) for i in plain(v[0], v[1:], 15, 0.5))
        fine = [(s, g) for s, g in scored if len(g) >= 3 and not g.isdigit() and "study" not in g.split()][:5]
        want |= {(k, g, -s, rank) for rank, (s, g) in enumerate(fine, 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want) and {r["doc_id"] for r in got} >= {2, 3, 7}


def test_runs_take_their_vectors_from_words_that_are_hashed_once(monkeypatch):
    words, known, hashed = ["alpha", "a_b", "__", "été", "alpha2"], {}, []
    runs = [(0, -1, -1), (1, -1, -1), (2, -1, -1), (0, 1, -1), (0, 0, 3), (3, 2, 4)]
    want = np.asarray(keywords.hashed_texts(pd.Series([" ".join(words[i] for i in r if i >= 0) for r in runs])), float)
    real = keywords.xxhash.xxh64_intdigest
    monkeypatch.setattr(keywords.xxhash, "xxh64_intdigest", lambda *a: hashed.append(a[0]) or real(*a))
    assert np.array_equal(keywords.hashed_runs(words, runs * 2000, known), np.tile(want, (2000, 1)))
    assert sorted(hashed) == sorted(p.encode() for p in ("alpha", "a", "b", "été", "alpha2"))


def test_the_two_built_in_encoders_agree(spark):
    texts = ["Alpha beta, Beta-gamma été", "", "a_b c"]
    rows = flows.embed(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), "text").select(F.col("text"), "vector").collect()
    for r in rows:
        assert np.allclose(keywords.hashed_texts(pd.Series([r["text"]]))[0], r["vector"])


def test_hopeful_grams_alone_are_shuffled_and_no_keyword_is_lost(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"word{k}" for k in range(30)] + ["the", "of", "ab", "2024", "été"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((9, 40, 90)))) for _ in range(60)] + ["a" * 60, "a" * 40 + " " + "b" * 40, "the of " * 20, "short", None, " ".join(f"rare{k}" for k in range(40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bad = {*flows.retrieval.STOP_WORDS}
    counts = []
    for t in texts:
        ws = [w for w in (t or "").split()] if t and len(t) >= 50 else []
        runs = [ws[i : i + n] for n in (1, 2, 3) for i in range(max(len(ws) - n + 1, 1))]
        counts.append(collections.Counter(" ".join(r) for r in runs if r and all(w not in bad and len(w) > 2 and not w.isdigit() for w in r)))
    df = collections.Counter(g for c in counts for g in c)
    want = set()
    for k, c in enumerate(counts):
        scored = sorted((-round(tf * len(g.split()) * math.log((len(texts) + 1) / df[g]), 4), g) for g, tf in c.items())
        want |= {(k, g, -s, rank) for rank, (s, g) in enumerate(scored[:10], 1)}
    for counters in (1 << 4, 1 << 22):  # many grams in a cell, or hardly two
        monkeypatch.setattr(flows, "COUNTERS", counters)
        got = flows.candidate_keywords(docs)
        assert {tuple(r) for r in got.collect()} == want
    moved = got._jdf.queryExecution().executedPlan().toString()
    assert "keyword" not in "".join(line for line in moved.splitlines() if "Exchange" in line)


def test_runs_are_told_apart_without_their_texts(monkeypatch):
    """Count and place of each different run as its texts would give them, each different word hashed once."""
    hashed, real = [], flows.xxhash.xxh3_128_digest
    monkeypatch.setattr(flows.xxhash, "xxh3_128_digest", lambda w: hashed.append(w) or real(w))
    rng, known, seen = random.Random(3), {}, {}
    for _ in range(60):
        words = [rng.choice(["ab", "cd", "abcd", "é", None, "x1"]) for _ in range(rng.choice((0, 1, 2, 3, 40)))]
        want = collections.Counter()
        for n in (1, 2, 3):
            for i in range(max(len(words) - n + 1, 1)):
                if (run := tuple(words[i : i + n])) and None not in run:
                    want[run] += 1
        start, size, tf, h = flows._grams(words, 3, known)
        runs = [tuple(words[a : a + k]) for a, k in zip(start, size, strict=True)]
        assert dict(zip(runs, tf.tolist(), strict=True)) == want and len(runs) == len(want)
        for run, x in zip(runs, map(bytes, h), strict=True):
            assert seen.setdefault(run, x) == x
    assert len(set(seen.values())) == len(seen) and len(hashed) == 6
