"""One chat flow: the papers that a question is about, the passages that go into its prompt, and the answer's claims against what it was given and what it cites."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docspark.functions.text import truncated
from docspark.operators import flows, retrieval, verification
from docspark.operators.cells import matrix
from docspark.operators.vectors import PLACES, _best
from docspark.sources.scratch import kept

#: Chunks and questions of a session that meet in one group, about, and questions that are worked on at a time.
SLICE, ASKED, AT_ONCE = 1 << 15, 1 << 10, 32
#: Keywords of which a group remembers where they are, ``SLICE`` bytes each.
REMEMBERED = 1024
#: Scores of a task may differ from those of the engine by so much.
SLACK = 1e-9


def named_papers(queries: DataFrame, papers: DataFrame, keywords: dict[str, list[str]]) -> DataFrame:
    """query_id, paper_id, boost: the papers of the session that the question names; one without any is about all of them.  ``papers`` has session_id, paper_id and title."""
    return flows.paper_boosts(queries, papers, keywords).where("boost > 1")


class Contained:
    """Where lower-case texts have a keyword, as ``retrieval.keyword_boost`` finds it, also without underscores.

    A keyword is made of a-z, 0-9 and _, so it stands within one run of these; it is looked for once in each different run, not in each text.
    """

    def __init__(self, texts: pa.Array) -> None:
        self.valid = texts.is_valid().to_numpy(zero_copy_only=False)
        split = pc.split_pattern_regex(pc.fill_null(texts, ""), "[^a-z0-9_]+")
        runs = split.flatten().dictionary_encode()
        names, code = runs.dictionary.to_pylist(), runs.indices.to_numpy()
        marked = [k for k, name in enumerate(names) if "_" in name]
        # All runs, and those with underscores without these: each list in one string, and where its runs begin there.
        self.lists = [self._list(names, np.arange(len(names))), self._list([names[k].replace("_", "") for k in marked], np.array(marked, np.int64))]
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
        self.rows = row[np.argsort(code, kind="stable")]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(names)))])

    @staticmethod
    def _list(names: list[str], runs: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
        return "\n".join(names), np.cumsum([0, *(len(name) + 1 for name in names)]), runs

    def __call__(self, word: str) -> np.ndarray:
        if not (bare := word.replace("_", "")):
            return self.valid
        has = np.zeros(len(self.valid), bool)
        for joined, begins, runs in self.lists:  # a run that has the keyword has it without underscores, too
            found, at = [], joined.find(bare)
            while at >= 0:
                found.append(at)
                at = joined.find(bare, at + 1)
            for run in runs[np.unique(np.searchsorted(begins, found, "right") - 1)].tolist():
                has[self.rows[self.starts[run] : self.starts[run + 1]]] = True
        return has


def session_hits(asked: DataFrame, named: DataFrame, papers: DataFrame, chunks: DataFrame, vectors: DataFrame, *, k: int, cap: int, step: float = 0.15) -> DataFrame:
    """query_id, paper_id, paragraph_id, score: of the best ``k`` chunks of each of a question's papers those that can be among its first ``cap`` tokens once papers and keywords have raised the scores.

    ``asked`` has query_id, session_id, keywords and vector, ``chunks`` paper_id and paragraph_id, ``vectors`` besides them text, token_count and vector.  Questions and chunks of a session meet in slices, whole papers in one;
    a question keeps of each slice what is before its cap there, so no row is written for a question and a paper, and what is written is a few hundred rows for a question and ``SLICE`` chunks.
    """
    of = papers.select("session_id", "paper_id").join(asked.select("session_id").distinct(), "session_id", "left_semi")
    parts = chunks.select("paper_id").join(of, "paper_id").groupBy("session_id").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("parts"))
    dealt = kept(parts.join(asked.groupBy("session_id").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("pieces")), "session_id"))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("parts")).cast("int").alias("part")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    placed = kept(asked.join(dealt, "session_id").withColumn("piece", F.pmod(F.xxhash64("query_id"), F.col("pieces")).cast("int")))
    own = named.join(placed.select("query_id", "parts"), "query_id").groupBy("query_id", part("paper_id")).agg(F.collect_list("paper_id").alias("papers"), F.collect_list("boost").alias("boosts"))
    some = placed.join(own, "query_id")
    every = placed.join(named.select("query_id").distinct(), "query_id", "left_anti").select("*", each("parts").alias("part"), F.lit(None).cast(own.schema["papers"].dataType).alias("papers"), F.lit(None).cast("array<double>").alias("boosts"))
    columns = ["session_id", "part", "piece", "query_id", "keywords", "vector", "papers", "boosts"]
    questions = some.select(*columns).unionByName(every.select(*columns))
    sides = vectors.where("vector is not null").select("paper_id", "paragraph_id", "text", "token_count", "vector").join(of, "paper_id").join(dealt, "session_id")
    sides = sides.select("session_id", part("paper_id"), each("pieces").alias("piece"), "paper_id", "paragraph_id", F.xxhash64("paper_id", "paragraph_id").alias("vec_id"), F.lower("text").alias("text"), "token_count", F.col("vector").cast("array<float>").alias("vector"))
    schema = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("paper_id", vectors.schema["paper_id"].dataType), T.StructField("paragraph_id", T.StringType()), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        left, right = left.combine_chunks(), right.combine_chunks()
        column = lambda t, name: c.combine_chunks() if isinstance(c := t.column(name), pa.ChunkedArray) else c
        v, ids = matrix(column(right, "vector")), column(right, "vec_id").to_numpy()
        tokens = pc.fill_null(column(right, "token_count"), 0).to_numpy(zero_copy_only=False)
        texts, of_paper = column(right, "text"), np.array(right.column("paper_id").to_pylist(), object)
        contained = lru_cache(maxsize=REMEMBERED)(Contained(texts))
        known, code, counts = np.unique(of_paper, return_inverse=True, return_counts=True)
        number = {p: i for i, p in enumerate(known)}
        order = np.argsort(code, kind="stable")
        large = [g for g in np.split(order, np.cumsum(counts)[:-1]) if len(g) > k]
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        for at in range(0, left.num_rows, AT_ONCE):
            some = left.slice(at, AT_ONCE)
            rows = some.select(["keywords", "papers", "boosts"]).to_pylist()
            exact = matrix(column(some, "vector")) @ v.T
            scores, best = np.round(exact, PLACES), np.ones(exact.shape, bool)
            for group in large:
                row, place, _ = _best(exact[:, group], ids[group], k)
                best[:, group] = False
                best[row, group[place]] = True
            has = {w: contained(w) for w in {w for r in rows for w in r["keywords"] or ()}}
            for n, r in enumerate(rows):
                boost = np.ones(len(known))
                if r["papers"] is not None:
                    boost[:] = np.nan  # not asked for
                    for p, b in zip(r["papers"], r["boosts"], strict=True):
                        if p in number:
                            boost[number[p]] = b
                mine = np.flatnonzero(best[n] & ~np.isnan(boost[code]))
                found = np.zeros(len(ids), np.int32)
                for w in r["keywords"] or ():
                    found += has[w]
                raised = scores[n, mine] * boost[code[mine]] * (1 + step * found[mine])
                if np.isfinite(raised).all():
                    down = np.argsort(-raised, kind="stable")
                    over = np.searchsorted(np.cumsum(tokens[mine[down]]), cap, side="right")
                    if over < len(down):  # what is below the first that exceeds the cap is after it in any order
                        mine = mine[raised >= raised[down[over]] - SLACK]
                out.append((at + n, mine, scores[n, mine]))
        rows, chosen = np.repeat([n for n, _, _ in out], [len(m) for _, m, _ in out]), np.concatenate([m for _, m, _ in out])
        made = [left.column("query_id").take(pa.array(rows, pa.int64())), right.column("paper_id").take(pa.array(chosen)), right.column("paragraph_id").take(pa.array(chosen)), pa.array(np.concatenate([s for _, _, s in out]))]
        return pa.Table.from_arrays(made, names=arrow.names).cast(arrow)

    key = ["session_id", "part", "piece"]
    return questions.groupBy(*key).cogroup(sides.groupBy(*key)).applyInArrow(meet, schema)


def contexts(
    queries: DataFrame, papers: DataFrame, chunks: DataFrame, *, keywords: dict[str, list[str]], k: int = 15, cap: int = 7692, budget: int = 12_000, encoder: Callable | None = None, index: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """The passages of each question's prompt (query_id, place, paper_id, paragraph_id, score, token_count) and the papers that they come from (query_id, paper_id, boost, ord).

    ``queries`` has query_id, session_id, text, history and paper_count.  A question meets the chunks of its own session's papers only, those that it names if it names any; their boosts
    raise the scores, and papers without a passage are pruned.  Metadata questions get nothing.  ``index`` is that of ``flows.retrieve``.
    """
    routed = kept(retrieval.classify_query(queries).where("query_type <> 'metadata'"))
    named = kept(named_papers(routed.select("query_id", "session_id", "text"), papers, keywords))
    asked = flows.embed(routed.select("query_id", "session_id", retrieval.query_keywords(F.col("text")).alias("keywords"), truncated(F.col("text"), 512).alias("text")), "text", encoder=encoder).drop("text")
    told = chunks.select("paper_id", "paragraph_id", "text", "token_count")
    vectors = flows.embed(told, "text", encoder=encoder) if index is None else told.join(index.select("paper_id", "paragraph_id", "vector"), ["paper_id", "paragraph_id"])
    hits = kept(session_hits(asked.where("vector is not null"), named, papers, chunks, vectors, k=k, cap=cap))
    own = kept(flows.only(chunks, hits, "paper_id"))
    hits = retrieval.apply_paper_boost(retrieval.hydrate(hits, own), named)
    chosen = kept(flows._within_budget(hits, own, routed, cap, budget))
    pairs = chosen.select("query_id", "paper_id").distinct().join(named, ["query_id", "paper_id"], "left")
    pruned = pairs.select("query_id", "paper_id", F.coalesce("boost", F.lit(1.0)).alias("boost"), F.col("paper_id").alias("ord"))
    return chosen, pruned


def verified_answers(answers: DataFrame, chosen: DataFrame, papers: DataFrame, chunks: DataFrame, *, encoder: Callable | None = None) -> DataFrame:
    """Every claim of every answer as in ``flows.verify_texts``, with ``from_citation`` (its source is a chunk that the prompt lacked and the answer cites) and ``no_sources``.

    ``answers`` has query_id and text; ``chosen`` and ``papers`` come from ``contexts``.  Cited chunks of the question's papers that are not in its prompt are added; answers without any source have all claims skipped.
    """
    texts = answers.select("query_id", "text")
    hits = chosen.join(chunks.select("paper_id", "paragraph_id", "text"), ["paper_id", "paragraph_id"])
    sources = kept(retrieval.add_cited(hits, texts, papers, chunks).select(F.col("query_id").alias("answer_id"), "paragraph_id", "added").dropDuplicates(["answer_id", "paragraph_id"]))
    made = kept(flows.verify_against(texts.withColumnRenamed("query_id", "answer_id"), sources.select("answer_id", "paragraph_id"), chunks, encoder=encoder))
    without = verification.missing_sources(made.select("answer_id", "claim_idx"), sources).select("answer_id", "claim_idx", F.lit(True).alias("no_sources"))
    added = sources.where("added").select("answer_id", "paragraph_id", F.lit(True).alias("from_citation"))
    flagged = made.join(added, ["answer_id", "paragraph_id"], "left").join(without, ["answer_id", "claim_idx"], "left")
    return flagged.withColumns({"from_citation": F.coalesce("from_citation", F.lit(False)), "no_sources": F.coalesce("no_sources", F.lit(False))})
