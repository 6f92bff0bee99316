"""Toxicity: a lexicon in a trie, met by Levenshtein automata, with context-window scores.

Learning.  Of the labelled rows whose hashed id is not held out, at most ``SAMPLE`` of each label (those of the least hash) are taken.  All words and word
beginnings of 4 to 6 letters that stand in ``LEAST_TEXTS`` toxic texts and hardly in others become the lexicon; it is the only thing besides the
sample's features, ``FEATURES`` numbers a row, that comes to the driver, and neither grows with the corpus, as the sample does not.  Of several texts with one id, the one of the least hash counts.

Matching.  The terms form a trie.  The Levenshtein automata of all terms are run over a word as one automaton whose states are sets of (trie node, edits);
states are made when first met and remembered, and most words leave it after a few letters.  Terms of 4 to 7 letters may be met with one edit, longer ones with two.

Context.  A hit counts more with other hits or an address (you) among the ``REACH`` words on either side, and less inside quotation marks or next to a word of
reporting; quotations may have any length.  A logistic regression of the counts by number of edits, the sum and greatest of the context scores and the density gives the score.

Null and empty texts have no hits and get the score of a text without hits.  Without labels of both kinds the score is the share of toxic labels (0 without any).
Every row gives one row, repeated ones too, an empty table none; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import computed

SAMPLE = 10_000
FEATURES = 7
REACH = 6
REMEMBERED = 200_000
LEAST_TEXTS = 3
LEAST_ODDS = 25.0
WORD = re.compile(r"[^\W_]+(?:[@$*!][^\W_]+)*")
NOT_WORD = r"[^\p{L}\p{N}]+"
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“", "‘": "’", "»": "«"}
ADDRESS = frozenset("you your youre yours ur tu te toi ton ta vous votre du dich dir dein deine ihr usted ustedes tú ti vosotros".split())
REPORT = frozenset("said says wrote writes called calls quote quoted quotes cited term word words phrase insult insults slur reported dit dite écrit appelé cité mot mots sagte schrieb nannte wort zitat dijo escribió llamó palabra cita".split())


class Automaton:
    """The Levenshtein automata of all terms, intersected with their trie and made deterministic as it is used."""

    def __init__(self, words: list[str], beginnings: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends, self.opens = [-1], [False]  # edits that the term that ends here may take; a beginning ends here
        self.slack = [0]  # most edits that any term from here on may take
        for term, opens in [(w, False) for w in words] + [(b, True) for b in beginnings]:
            allowed = 0 if opens or len(term) < 4 else 1 if len(term) < 8 else 2
            node = 0
            self.slack[0] = max(self.slack[0], allowed)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.opens.append(False)
                    self.slack.append(0)
                node = self.children[node][c]
                self.slack[node] = max(self.slack[node], allowed)
            if opens:
                self.opens[node] = True
            else:
                self.ends[node] = max(self.ends[node], allowed)
        self.known: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[int] = []
        self.start = self._number(self._closed({0: 0}), False)

    def _closed(self, nodes: dict[int, int]) -> dict[int, int]:
        """With letters of a term that the word leaves out."""
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            if nodes.get(node) != e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.slack[child] and nodes.get(child, 9) > e + 1:
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        return nodes

    def _number(self, nodes: dict[int, int], opened: bool) -> int:
        key = (opened, *sorted(nodes.items()))
        if key not in self.numbers:
            if not nodes and not opened:
                return -1
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            self.accepts.append(min([e for n, e in nodes.items() if e <= self.ends[n]], default=3 if opened else -1))
        return self.numbers[key]

    def _step(self, state: int, c: str) -> int:
        opened, *pairs = self.states[state]
        nodes: dict[int, int] = {}
        for node, e in pairs:
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.slack[child] and nodes.get(child, 9) > cost:
                    nodes[child] = cost
                    opened = opened or not cost and self.opens[child]
            if e + 1 <= self.slack[node] and nodes.get(node, 9) > e + 1:
                nodes[node] = e + 1
        return self._number(self._closed(nodes), opened)

    def edits(self, word: str) -> int:
        """Least edits to a term, 3 if only a beginning is met, -1 for no hit."""
        if (found := self.known.get(word)) is not None:
            return found
        if len(self.states) > REMEMBERED or len(self.known) > REMEMBERED:
            self.known.clear()
            if len(self.states) > REMEMBERED:
                self._reset()
        state = self.start
        for c in word:
            following = self.steps[state].get(c)
            if following is None:
                following = self.steps[state][c] = self._step(state, c)
            state = following
            if state < 0:
                break
        found = self.known[word] = self.accepts[state] if state >= 0 else -1
        return found


def features_of(text: str, automaton: Automaton) -> list[float]:
    words = WORD.findall(text.lower())
    known, edits = automaton.known.get, automaton.edits
    found = [known(w) if known(w) is not None else edits(w) for w in words]
    at = [i for i, e in enumerate(found) if e >= 0]
    if not at:
        return [0.0] * FEATURES
    counts = [0, 0, 0, 0]
    for i in at:
        counts[found[i]] += 1
    quoted = _quoted(text.lower(), len(words))
    scores, low, high = [], 0, 0
    for i in at:
        while at[low] < i - REACH:
            low += 1
        while high < len(at) and at[high] <= i + REACH:
            high += 1
        near = words[max(0, i - REACH) : i + REACH + 1]
        score = 1.0 + 0.7 * math.log1p(high - low - 1) + 0.5 * any(w in ADDRESS for w in near)
        if i in quoted:
            score *= 0.25
        if any(w in REPORT for w in near):
            score *= 0.5
        scores.append(score)
    return [*map(math.log1p, counts), math.log1p(sum(scores)), max(scores), len(at) / len(words)]


def _quoted(text: str, n: int) -> set[int]:
    """Numbers of the words inside quotation marks; a mark that is never closed opens nothing."""
    if not any(q in text for q in QUOTES):
        return set()
    inside: set[int] = set()
    opened, mark, end = None, "", 0
    for k, m in enumerate(WORD.finditer(text)):
        for c in text[end : m.start()]:
            if opened is not None and c == QUOTES[mark]:
                inside.update(range(opened, k))
                opened = None
            elif opened is None and c in QUOTES:
                opened, mark = k, c
        end = m.end()
    if opened is not None and QUOTES[mark] in text[end:]:
        inside.update(range(opened, n))
    return inside


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model:
    """A lexicon and the weights of the features."""

    def __init__(self, words: list[str], beginnings: list[str], weights: list[float], prior: float):
        self.words, self.beginnings, self.weights, self.prior = words, beginnings, weights, prior

    def score(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """id_col, score of every row."""
        scored = _features(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), self.words, self.beginnings)
        if not self.weights:
            return scored.select(F.col("id").alias(id_col), F.lit(float(self.prior)).alias("score"))
        z = F.lit(self.weights[0])
        for k, w in enumerate(self.weights[1:]):
            z = z + F.lit(w) * F.get("features", F.lit(k))
        return scored.select(F.col("id").alias(id_col), (1 / (1 + F.exp(-z))).alias("score"))


def _features(rows: DataFrame, words: list[str], beginnings: list[str]) -> DataFrame:
    def make():
        automaton = Automaton(words, beginnings)
        return lambda text: (features_of(text or "", automaton),)

    return computed(rows, ["text"], "features array<double>", make)


def learn(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of the labelled rows that are not held out. Several labels of an id count as toxic if one is."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic")).where(F.col("toxic").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    usable = usable.groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = totals.get(1, 0) / max(1, sum(totals.values()))
    if len(totals) < 2:
        return Model([], [], [], prior)
    some = [usable.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (0, 1)]
    # At most twice ``sample`` rows of an id and a label: broadcast, so that no text is moved to find the sampled ones.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some[0].union(some[1])), "id")
    # One text an id, so that the sample has a bound in texts too; and copies of a text would each count its every word.
    rows = rows.groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "toxic")).alias("row")).select("id", "row.text", "row.toxic")
    rows = rows.groupBy(F.xxhash64("text").alias("hash")).agg(F.min(F.struct("id", "text", "toxic")).alias("row")).select("row.*")
    rows = rows.where("text is not null").persist()
    try:
        there = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        if len(there) < 2:
            return Model([], [], [], prior)
        words, beginnings = _lexicon(rows, there)
        made = _features(rows, words, beginnings).select("toxic", "features").toPandas()
    finally:
        rows.unpersist()
    x, y = np.array(made["features"].tolist()), made["toxic"].to_numpy(float)
    weight = np.where(y > 0, totals[1] / there[1], totals[0] / there[0])
    return Model(words, beginnings, _regression(x, y, weight / weight.mean()), prior)


def _lexicon(rows: DataFrame, there: dict[int, int]) -> tuple[list[str], list[str]]:
    terms = F.array_distinct(F.array_remove(F.split(F.lower("text"), NOT_WORD), ""))
    starts = F.array_distinct(F.flatten(F.transform(F.filter(terms, lambda w: F.length(w) > 4), lambda w: F.transform(F.sequence(F.lit(4), F.least(F.length(w) - 1, F.lit(6))), lambda n: F.substring(w, F.lit(1), n)))))
    found = []
    for column in (terms, starts):
        counts = rows.select("toxic", F.explode(column).alias("term")).groupBy("term").agg(F.sum("toxic").alias("yes"), F.sum(1 - F.col("toxic")).alias("no")).where(F.col("yes") >= LEAST_TEXTS)
        odds = ((F.col("yes") + 0.5) / (there[1] + 1)) / ((F.col("no") + 0.5) / (there[0] + 1))
        kept = counts.withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).orderBy("term")
        found.append([r["term"] for r in kept.collect()])
    return found[0], found[1]


def _regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> list[float]:
    """Intercept and weights of a logistic regression with a ridge, by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]
