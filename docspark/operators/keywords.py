"""Keywords of documents: likeness to the whole text, spread out by maximal marginal relevance."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.operators.flows import DIMS, hashed_words

# Words that make a keyword too general.
GENERAL = (
    "abstract", "introduction", "conclusion", "results", "discussion", "methodology", "background", "related work", "future work", "experimental", "experiments", "evaluation", "proposed", "method", "approach", "system", "model",
    "analysis", "study", "paper", "author", "authors", "table", "figure", "et al", "university", "department", "institute", "research", "researchers", "framework", "performance", "findings", "contributions", "fig", "dataset", "data",
    "algorithm", "solution", "problem", "case study", "applications", "references", "acknowledgments", "appendix", "proceedings", "conference", "journal", "volume", "issue", "pages", "year", "date", "published", "doi", "url", "http",
    "https", "www", "com", "org", "edu", "table 1", "table 2", "fig 1", "fig 2", "et", "al", "ibid", "cf", "eg", "ie", "viz",
)


def hashed_texts(texts: pd.Series) -> list[np.ndarray]:
    """Built-in encoder of plain texts: the vectors of ``flows.embed``, whose hash of a word is XXH64 with the seed 42."""
    known: dict[str, int] = {}

    def of(word: str) -> int:
        if word not in known:
            known[word] = xxhash.xxh64_intdigest(word.encode(), 42)
        return known[word]

    words = [[of(w) for w in re.split(r"[\W_]+", t.lower()) if w] for t in texts]
    return hashed_words(pd.Series([np.array(ws, np.uint64).astype(np.int64) for ws in words], dtype=object), DIMS)


#: Words whose places are remembered in a task.
REMEMBERED = 1_000_000


def hashed_runs(words: list[str], runs: list[tuple[int, ...]], known: dict[str, list[int]]) -> np.ndarray:
    """The vectors that ``hashed_texts`` gives the runs of ``words`` (places in it, -1 for none), each word hashed once: counts of a run are the sum of its words' counts."""
    if len(known) > REMEMBERED:
        known.clear()
    places = []
    for w in words:
        if w not in known:
            known[w] = [int(np.int64(np.uint64(xxhash.xxh64_intdigest(p.encode(), 42)))) % DIMS for p in re.split(r"[\W_]+", w.lower()) if p]
        places.append(known[w])
    row = np.repeat(np.arange(len(words)), [len(p) for p in places])
    at = row * DIMS + np.array([x for p in places for x in p], np.int64)
    counts = np.bincount(at, minlength=(len(words) + 1) * DIMS).reshape(-1, DIMS).astype(np.float64)  # the last row, that of -1, is empty
    out = np.empty((len(runs), DIMS), np.float64)
    for k in range(0, len(runs), 4096):
        v = counts[np.array(runs[k : k + 4096], np.int64)].sum(1)
        norm = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
        out[k : k + 4096] = (v / np.where(norm > 0, norm, 1)).astype(np.float32)
    return out


def spread_out(text: np.ndarray, candidates: np.ndarray, most: int, diversity: float) -> list[int]:
    """Greedy maximal marginal relevance: the candidate most like the text, then again and again the one of the largest (1 - d) likeness to the text less d likeness to the nearest chosen one; ties to the lower index.

    One product of all candidates with the last chosen one keeps every value up to date.
    """
    if not len(candidates):
        return []
    relevance = np.round(candidates @ text, 6)
    nearest, chosen = np.full(len(candidates), -np.inf), [int(relevance.argmax())]
    while len(chosen) < min(most, len(candidates)):
        np.maximum(nearest, np.round(candidates @ candidates[chosen[-1]], 6), out=nearest)
        value = np.round((1 - diversity) * relevance - diversity * nearest, 9)
        value[chosen] = -np.inf
        chosen.append(int(value.argmax()))
    return chosen


def _wanted(keyword: str) -> bool:
    return len(keyword) >= 3 and not keyword.isdigit() and keyword not in GENERAL and not any(w in GENERAL for w in keyword.split())


def mmr_keywords(
    docs: DataFrame, *, top_n: int = 10, most_words: int = 3, diversity: float = 0.5, over: int = 3, shortest: int = 50, encoder: Callable[[pd.Series], list] | None = None, stop_words: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id_col, keyword, score (likeness to the text, 4 places), rank.

    Candidates are the distinct runs of one to ``most_words`` words of two letters or more once stop words are taken out.  ``over`` times ``top_n`` of them are chosen with ``diversity``, then put in the
    order of their likeness (ties alphabetically), and of those that are neither short, numbers nor general the first ``top_n`` count.  Texts under ``shortest`` characters have none.  Everything about a document happens in
    the task that holds it, and nothing is shuffled; ``encoder`` maps a series of texts to unit vectors and gets a document's candidates at a time.  The built-in one takes a candidate's vector from its words.
    """
    stop = StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else stop_words
    words = F.filter(F.regexp_extract_all(F.lower(text_col), F.lit(r"([\p{L}\p{N}_]{2,})"), 1), lambda w: ~w.isin(stop))
    rows = docs.where(F.length(F.trim(text_col)) >= shortest).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), words.alias("words"))

    def candidates(text: str, ws: list[str], known: dict[str, list[int]]) -> tuple[list[str], np.ndarray]:
        """The candidates in the order of their text, and the vectors of the text and of them."""
        if encoder:
            grams = sorted({" ".join(ws[i : i + n]) for n in range(1, most_words + 1) for i in range(len(ws) - n + 1)})
            return grams, np.asarray(list(encoder(pd.Series([text, *grams]))), np.float64) if grams else np.zeros((1, DIMS))
        number = {w: k for k, w in enumerate(dict.fromkeys(ws))}
        at = [number[w] for w in ws]
        runs = {}
        for n in range(1, most_words + 1):
            rest = (-1,) * (most_words - n)
            for i in range(len(ws) - n + 1):
                runs[" ".join(ws[i : i + n])] = (*at[i : i + n], *rest)
        grams = sorted(runs)
        return grams, np.vstack([np.asarray(hashed_texts(pd.Series([text]))[0], np.float64)[None], hashed_runs(list(number), [runs[g] for g in grams], known)]) if grams else np.zeros((1, DIMS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            out = []
            for id_, text, ws in zip(batch["id"], batch["text"], batch["words"], strict=True):
                grams, vectors = candidates(text, list(ws), known)
                if not grams:
                    continue
                chosen = spread_out(vectors[0], vectors[1:], over * top_n, diversity)
                scored = sorted(((-round(float(vectors[i + 1] @ vectors[0]), 4), grams[i]) for i in chosen))
                out += [(id_, k, -s, rank) for rank, (s, k) in enumerate([x for x in scored if _wanted(x[1])][:top_n], 1)]
            yield pd.DataFrame(out, columns=["id", "keyword", "score", "rank"])

    kind = next(f.dataType.simpleString() for f in docs.schema if f.name == id_col)
    return rows.mapInPandas(run, f"id {kind}, keyword string, score double, rank long").withColumnRenamed("id", id_col)
