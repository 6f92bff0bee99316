"""The chat flow: each of its steps changes something."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docspark.operators import chat, flows, retrieval

CHUNKS = "paper_id long, session_id string, ord long, text string, paragraph_id string, token_count long, chunk_type string, section string"


@pytest.fixture(scope="module")
def tables(spark):
    topics = {11: "rivers and their banks", 12: "bridges made of steel", 13: "the price of bread", 21: "rivers and their banks"}
    rows = [(p, "a" if p < 20 else "b", o, f"Passage {o} of paper {p} tells of {t} in its own words.", f"{p}_P{o}", 20, "text", "Body") for p, t in topics.items() for o in range(6)]
    chunks = spark.createDataFrame(rows, CHUNKS).cache()
    papers = spark.createDataFrame([("a", 11, "Rivers"), ("a", 12, "Bridges"), ("a", 13, "Bread"), ("a", 14, "Empty"), ("b", 21, "Rivers")], "session_id string, paper_id long, title string").cache()
    return chunks, papers


def asked(spark, *rows):
    return spark.createDataFrame([(*r, False, 3) for r in rows], "query_id long, session_id string, text string, history boolean, paper_count int")


def test_questions_meet_the_papers_of_their_session_that_they_name(spark, tables):
    chunks, papers = tables
    queries = asked(spark, (1, "a", "what is told of rivers and their banks"), (2, "a", "what does paper 2 tell"), (3, "a", "which steel is it, and what of bread"), (4, "b", "and of rivers"), (5, "a", "who is the author"))
    chosen, left = chat.contexts(queries, papers, chunks, keywords={"none": ["zzz"]}, k=2)
    of = {}
    for r in chosen.collect():
        of.setdefault(r["query_id"], set()).add(r["paper_id"])
    assert of[1] == {11}  # the title is named
    assert of[2] == {12}  # the second paper of the session
    assert of[3] == {13} and of[4] == {21}
    assert {(r["query_id"], r["paper_id"]) for r in left.collect()} == {(q, p) for q, ps in of.items() for p in ps}
    assert max(r["count"] for r in chosen.groupBy("query_id", "paper_id").count().collect()) <= 2
    wide, pruned = chat.contexts(asked(spark, (7, "a", "what is told here")), papers, chunks, keywords={}, k=2)
    assert {r["paper_id"] for r in wide.collect()} == {11, 12, 13} == {r["paper_id"] for r in pruned.collect()}  # paper 14 has no passage


def test_cited_passages_count_and_answers_without_sources_are_marked(spark, tables):
    chunks, papers = tables
    queries = asked(spark, (1, "a", "what does paper 1 tell"), (2, "c", "a session without papers"))
    chosen, left = chat.contexts(queries, papers, chunks, keywords={}, k=1)
    given = {r["paragraph_id"] for r in chosen.collect()}
    lacking = next(f"11_P{k}" for k in range(6) if f"11_P{k}" not in given)
    said = f"Passage {lacking[-1]} of paper 11 tells of rivers and their banks in its own words."
    answers = spark.createDataFrame([(1, f"{said} [{lacking}]"), (2, "Nothing is known of it at all, sadly.")], "query_id long, text string")
    rows = {r["answer_id"]: r for r in chat.verified_answers(answers, chosen, left, chunks).where(F.length("claim") > 20).collect()}
    assert rows[1]["paragraph_id"] == lacking and rows[1]["from_citation"] and rows[1]["confidence"] == "high" and not rows[1]["no_sources"]
    assert rows[2]["no_sources"] and rows[2]["method"] == "skipped" and rows[2]["score"] == 0.0
    plain = spark.createDataFrame([(1, said)], "query_id long, text string")
    alone = chat.verified_answers(plain, chosen, left, chunks).collect()[0]
    assert alone["paragraph_id"] != lacking and not alone["from_citation"]


@pytest.mark.parametrize(("size", "asked_at_once"), [(1 << 15, 1 << 10), (40, 2)])
def test_a_question_to_many_papers_writes_rows_up_to_its_cap(spark, monkeypatch, size, asked_at_once):
    """Against a full ranking of the best of each paper, not a row for each question and paper; a session is one slice or many."""
    monkeypatch.setattr(chat, "SLICE", size)
    monkeypatch.setattr(chat, "ASKED", asked_at_once)
    words = "stone bridge river bread price north wind paper copper glass".split()
    texts = {(p, o): " ".join(words[(p * p + o * i * i + i) % 10] for i in range(5 + (p * o) % 9)) + (" the_price" if p % 5 == 0 else "") for p in range(60) for o in range(1 + p % 7)}
    chunks = spark.createDataFrame([(p, "a", o, t, f"{p}_P{o}", 3 + (p + o) % 5, "text", "Body") for (p, o), t in texts.items()], CHUNKS).cache()
    papers = spark.createDataFrame([("a", p, "Copper works" if p in (3, 4) else f"Title {p}") for p in range(60)], "session_id string, paper_id long, title string").cache()
    queries = asked(spark, (1, "a", "what of bridge and river stone"), (2, "a", "is copper works meant here"), (3, "a", "tell of the_price and wind and glass"), (4, "a", "paper 7 or document 9 on bread")).cache()
    k, cap = 3, 60
    named = chat.named_papers(queries, papers, {}).cache()
    boosts = {(r["query_id"], r["paper_id"]): r["boost"] for r in named.collect()}
    assert boosts == {(2, 3): 1.5, (2, 4): 1.5, (4, 6): 2.0, (4, 8): 2.0}
    routed = flows.embed(queries.select("query_id", "session_id", "text", retrieval.query_keywords(F.col("text")).alias("keywords")), "text").drop("text").cache()
    vectors = flows.embed(chunks, "text").withColumn("vec_id", F.xxhash64("paper_id", "paragraph_id")).cache()
    want, all_ = set(), 0
    stored = vectors.collect()
    for q in routed.collect():
        of = {}
        for c in stored:
            boost = boosts.get((q["query_id"], c["paper_id"]), None if any(i == q["query_id"] for i, _ in boosts) else 1.0)
            if boost is not None:
                score = round(float(np.dot(np.array(q["vector"], float), np.array(c["vector"], float))), 6)
                found = sum(w in c["text"] or w.replace("_", "") in c["text"].replace("_", "") for w in q["keywords"])
                of.setdefault(c["paper_id"], []).append((-score, c["vec_id"], score * boost * (1 + 0.15 * found), c["ord"], c["token_count"], c["paragraph_id"]))
        best = [(-raised, p, o, n, pid) for p, rows in of.items() for _, _, raised, o, n, pid in sorted(rows)[:k]]
        all_, used = all_ + len(best), 0
        for _, _, _, n, pid in sorted(best):
            used += n
            if used <= cap:
                want.add((q["query_id"], pid))
    hits = chat.session_hits(routed, named, papers, chunks, vectors.drop("vec_id"), k=k, cap=cap).cache()
    assert want <= {(r["query_id"], r["paragraph_id"]) for r in hits.collect()} and hits.count() < all_ * (0.3 if size > 40 else 0.9)
    chosen, _ = chat.contexts(queries, papers, chunks, keywords={}, k=k, cap=cap)
    assert {(r["query_id"], r["paragraph_id"]) for r in chosen.collect()} == want


def test_keywords_are_looked_for_in_different_runs_and_found_as_in_every_text():
    rng = random.Random(4)
    texts = pa.array([None if rng.random() < 0.05 else "".join(rng.choice("ab_1é -\nß.") for _ in range(rng.randint(0, 30))) for _ in range(800)] + ["the same_words again"] * 5000)
    words = ["".join(rng.choice("ab_1") for _ in range(rng.randint(2, 5))) for _ in range(300)] + ["__", "a_", "_b", "same", "samewords", "sam_e", "words"]
    of = chat.Contained(texts)
    assert sum(len(runs) for _, _, runs in of.lists) < 2 * 800 * 8  # repeats are looked at once
    for w in words:
        bare = w.replace("_", "")
        assert of(w).tolist() == [t is not None and (w in t or bare in t.replace("_", "")) for t in texts.to_pylist()], w
    for few in (pa.array([], pa.string()), pa.array([None], pa.string()), pa.array(["", " "])):
        assert not chat.Contained(few)("ab").any()


def test_texts_of_papers_without_a_hit_do_not_move(spark, monkeypatch):
    """Retrieval keeps the chunks of the papers that were hit, and whatever comes after meets only these."""
    words = "stone bridge river bread price north wind paper copper glass".split()
    chunks = spark.createDataFrame([(p, "a", o, f"{words[p % 10]} {words[p // 10]} {words[o]} number {p}", f"{p}_{'F' if o == 2 else 'P'}{o}", 4, "figure" if o == 2 else "text", "Body") for p in range(100) for o in range(3)], CHUNKS).cache()
    hits = spark.createDataFrame([(1, 7), (2, 7), (2, 55), (3, None), (3, 777)], "query_id long, paper_id long")
    assert sorted(r["paper_id"] for r in flows.only(chunks, hits, "paper_id").collect()) == [7, 7, 7, 55, 55, 55]
    sizes, real = [], flows.kept
    monkeypatch.setattr(flows, "kept", lambda df: sizes.append((made := real(df)).count() * ("text" in df.columns)) or made)
    found = flows.retrieve(asked(spark, (1, "a", "copper glass and stone"), (2, "a", "river bread compared to wind")), chunks, k=4)
    assert found.count() > 4 and 0 < max(sizes) <= 2 * 4 * 3
