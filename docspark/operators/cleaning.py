"""Noise reasons, prompt quarantine and text normalisation as expression chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.text import let, word_count

SHORTEST = 4

# Patterns of noise, in the order in which they are tried.
HEADER = [r"^Table\s+\d+\s*:", r"^Figure\s+\d+\s*:|^Fig\.\s+\d+\s*:", r"^Eq(?:uation)?\s+\d+\s*:|^Formula\s+\d+\s*:", r"^(?:Stack|Goal|State|Input|Output)\s+\d*\s*:"]
FOOTNOTE = r"^[\d†‡*§¶]+\.?\s*$"
SEPARATOR = r"^[-=_*~]{3,}\s*$"
PAGE_NUMBER = r"^(?:page\s+\d+|p\.\s*\d+|-\s*\d+\s*-|\d{1,4})$"
SECTION_HEADER = r"^(?:\d+\.[\d.]*\s+[A-Z]|[A-Z]\.[\d.]*\s+[A-Z]|[IVX]+\.\s+[A-Z])"
IDENTIFIER = [
    r"^https?://\S+$|^www\.\S+$|^ftp://\S+$", r"^(?:doi:\s*10\.\S+|https?://doi\.org/\S+)$", r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$",
    r"^(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}|\d{1,2}/\d{1,2}/\d{4}|Accessed:\s*.+)$",
]
REFERENCE = r"^(?:\[\d+\]\s*[A-Z]|(?:References|Bibliography|Works Cited)\s*$)"
COPYRIGHT = r"(?:\x{a9}|copyright|all rights reserved|licensed under|creative commons|permission is granted|open access)"
BOILERPLATE = r"^(?:Preprint|Submitted to|Accepted:|Published:|Received:|Revised:|Under review|Draft|Proceedings of|Conference on|arXiv:\d|Available at|Correspondence:|Keywords:)\s*"
LATEX = r"\\(?:begin|end|textbf|textit|cite|ref|label|section|subsection|caption|centering|includegraphics|usepackage)\s*\{"
ARTEFACT = [
    r"^[\s•◦▪■○►◆★✦✓✗❑●⬤\-–—·]+$", r"^[\s\[\](){}]*$|^\[\s*\?\s*\]$|^\(\s*(?:see\s*)?\)$", r"^(?:\[[\d,;\s–-]+\])+\.?\s*$",
    r"^(?:DRAFT|PREPRINT|CONFIDENTIAL|DO NOT DISTRIBUTE|UNDER REVIEW|EMBARGOED?|SAMPLE|PROOF|UNCORRECTED)\s*$",
]
ISSN, VOLUME = r"^(?:e?ISSN|ISBN)[\s:]*[\dXx\-]+", r"^(?:Vol(?:ume)?\.?\s+\d|Issue\s+\d|No\.\s*\d|pp\.?\s*\d)"
FUNDING = (
    r"^(?:This (?:work|research|study|project) (?:was|is) (?:supported|funded|sponsored|financed)|(?:Supported|Funded|Sponsored|Financed) (?:by|in part)|"
    r"(?:Grant|Funding|Financial support|Acknowledgment)s?\s*(?::|from|by)|The authors? (?:acknowledge|thank|would like to thank|gratefully))"
)
JOURNAL = r"^(?:Journal of|Proceedings of|Transactions on|IEEE\s|ACM\s|Springer|Elsevier|Wiley|Nature\s|Science\s|PLOS\s|Frontiers in|Annals of|International (?:Journal|Conference)|Annual (?:Meeting|Conference))"
AFFILIATION = r"(?:University|Department|Institute|Laboratory|Lab\b|School of|Faculty of|Center for|Centre for|College of|Hospital|Research Group|Division of)"
IMAGE = r"!\[[^\]]*\]\([^)]*\)"

# Phrases that reject a prompt.
INJECTION = [
    r"ignore\s+(previous|prior|all)\s+(instructions?|prompts?)", r"you\s+are\s+now\s+a", r"forget\s+(everything|all|your)\s+instructions?", r"new\s+system\s+prompt",
    r"disregard\s+(all|previous|prior)\s+(instructions?|prompts?)", r"\[INST\]|\[\/INST\]|<\|system\|>|<\|user\|>", r"override\s+your\s+(instructions?|programming|guidelines)",
    r"do\s+not\s+(follow|obey|listen\s+to)", r"jailbreak", r"prompt\s+injection", r"roleplay\s+as", r"pretend\s+to\s+be", r"access\s+developer\s+mode",
]
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def _is(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + pattern)


def noise_reason(c: Column) -> Column:
    """Why a source sentence is noise, by the first reason that holds; null if it is not. The trimmed text and its number of words are computed once."""
    counted = let(F.regexp_replace(c, r"^\s+|\s+$", ""), lambda t: F.struct(t.alias("t"), word_count(t).alias("n")))
    return F.when(c.isNull(), "empty").otherwise(let(counted, lambda s: _reason(s["t"], s["n"])))


def _reason(t: Column, n: Column) -> Column:
    share = lambda kept: F.length(F.regexp_replace(t, kept, "")) / F.length(t)
    any_of = lambda patterns: _is(t, "|".join(f"(?:{p})" for p in patterns))
    reference = _is(t, REFERENCE) | ((t.startswith("- [") | t.startswith("[")) & F.substring(t, 1, 5).rlike(r"\d"))
    return (
        F.when(t == "", "empty").when(n < SHORTEST, "short").when(t.startswith("|") | any_of(HEADER), "header")
        .when(t.rlike(FOOTNOTE) | t.rlike(SEPARATOR), "separator").when(_is(t, PAGE_NUMBER), "page_number").when((n < 8) & t.rlike(SECTION_HEADER), "section_header")
        .when(any_of(IDENTIFIER), "identifier").when(reference, "reference").when(_is(t, COPYRIGHT) | _is(t, BOILERPLATE), "boilerplate").when(t.contains("\\") & t.rlike(LATEX), "latex")
        .when(share(r"[^\p{L}]") < 0.30, "few_letters").when(any_of(ARTEFACT), "artefact").when(any_of([ISSN, VOLUME, FUNDING]), "metadata")
        .when((n < 15) & any_of([JOURNAL, AFFILIATION]), "metadata").when((F.length(t) >= 10) & (share(r"[\p{L}\p{N}\s]") > 0.40), "special_characters")
        .when(t.contains("![") & (word_count(F.regexp_replace(t, IMAGE, "")) < SHORTEST), "image")
    )


def noise_profile(df: DataFrame, column: str = "text") -> DataFrame:
    """Rows dropped by reason. The rows that stay are counted as none of theirs, after the aggregate; a filter before it would evaluate every reason twice."""
    return df.select(noise_reason(F.col(column)).alias("reason")).groupBy("reason").agg(F.count("reason").alias("n_rows")).where("n_rows > 0")


def prompt_status(c: Column) -> tuple[Column, Column]:
    """The cleaned prompt, and the number (from 1) of the pattern that rejects it: 0 for none, -1 for an empty prompt."""
    clean = F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), CONTROL, "")
    found = F.lit(0)
    for k, pattern in reversed(list(enumerate(INJECTION, 1))):
        found = F.when(_is(clean, pattern), k).otherwise(found)
    return clean, F.when(F.coalesce(clean, F.lit("")) == "", -1).otherwise(found)


def quarantine_prompts(df: DataFrame, column: str = "text") -> DataFrame:
    clean, rejected = prompt_status(F.col(column))
    return df.withColumns({"clean": clean, "rejected_by": rejected})


def bad_id_list(ids: Column, *, least: int = 1, most: int = 1_000_000) -> Column:
    """True unless every id is a UUID, none repeats and the list has an allowed size."""
    uuid = r"^(?i)[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\z"
    return ~(F.forall(ids, lambda x: x.rlike(uuid)) & (F.size(F.array_distinct(ids)) == F.size(ids)) & F.size(ids).between(least, most))


# What is rewritten, in this order.
RULES = {
    "claim": [(r"\*{1,3}(.+?)\*{1,3}", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^[\s]*[-*+]\s+", ""), (r"(?m)^[\s]*\d+\.\s+", ""), (r"\n{3,}", "\n\n")],
    "final": [(r",\s*,+", ", "), (r",+\s*\.", "."), (r"\.\.+", "."), (r"\s+,\s+", ", ")],
    "uncite": [(r"\[(?:[a-f0-9]{1,8}_)?[PTFE]\d+(?:-S\d+)?\]", "")],
}


def normalise_text(df: DataFrame, rules: str, column: str = "text") -> DataFrame:
    """Adds ``normalised`` and ``changed``."""
    out = F.col(column)
    for pattern, to in RULES[rules]:
        out = F.regexp_replace(out, pattern, to)
    out = F.regexp_replace(out, r"^\s+|\s+$", "")
    return df.withColumns({"normalised": out, "changed": ~out.eqNullSafe(F.col(column))})
