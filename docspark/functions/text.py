"""Column helpers that the operators share; all stay inside the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A citation such as [P3] or [ab12_T4].
CITATION = r"\[((?:[a-f0-9]{1,8}_)?[PTFE]\d+)\]"


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once, however often ``of`` names it; the optimiser would write it out each time."""
    return F.element_at(F.transform(F.array(value), of), 1)


def words(c: Column) -> Column:
    """The words between white space."""
    return F.array_remove(F.split(c, r"\s+"), "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def token_count(c: Column) -> Column:
    """1.3 tokens a word, rounded down, at least 1; null counts as empty."""
    return F.greatest(F.lit(1), F.floor(word_count(F.coalesce(c, F.lit(""))) * F.lit(1.3)).cast("long"))


def truncated(c: Column, tokens: int) -> Column:
    """The first ``4 * tokens`` characters back to the last blank, with an ellipsis, where the text is longer."""
    head = F.regexp_replace(F.substring(c, 1, 4 * tokens), " [^ ]*$", "")
    return F.when(F.length(c) <= 4 * tokens, c).otherwise(F.concat(head, F.lit("…")))


def paragraph_type(paragraph_id: Column) -> Column:
    """Figure, table or formula by the letter after the last underscore, else text."""
    first = F.substring(F.substring_index(paragraph_id, "_", -1), 1, 1)
    return F.when(first == "F", "figure").when(first == "T", "table").when(first == "E", "formula").otherwise("text")


def confidence(score: Column, high: float = 0.85, medium: float = 0.65) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), x))))


def matches_any(c: Column, patterns: list[str]) -> Column:
    return c.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))
