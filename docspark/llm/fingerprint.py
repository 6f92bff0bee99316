"""Document fingerprints by consistent weighted sampling.

A text is a bag of word pairs; a term's weight is ``1 + ln(count)``.  For every sample and term three numbers are drawn from the term's
hash alone, as the gamma-based scheme has it: a step r and a value c, both Gamma(2, 1), and a phase b, uniform.  They fix a lattice of weights with
the step r in logarithms; with z the lattice point above the term's weight its value is c / z, and the sample of the text is the term, with
its lattice point, of the least value.  Two texts agree in a sample with the probability of their generalised Jaccard similarity, the sum of least over the sum of
greatest weights.

The numbers are drawn in another order than they are used, which changes no distribution: a Gamma(2, 1) cut at a uniform place is two independent exponentials.  So
e1 and e2, exponential, and u, uniform, are drawn, and stand for c = e1 + e2, the lattice points c / e1 above and u below weight 1, and r the
difference of their logarithms.  The value at weight 1 is then e1, which grows with the hash; so among terms that occur once, by far the most, the least hash
is found by one multiplication and one comparison, and only terms that repeat need logarithms.  A term whose weight is m lattice points further has the value e1 exp(-r m).

Words and their hashes are made by Spark; a vectorised function joins the hashes to pairs and samples them in pieces of ``PIECE`` terms, so its memory is
a small multiple of the array that it gets.  Where several texts of a row start with the same terms, those are sampled once.  A fingerprint is ``samples`` numbers of 16 bits in
hexadecimal; the last 16 bits of two different samples agree by chance in one of 65536 cases, which ``likeness`` does not correct.

Null counts as empty text.  A text without words has the empty fingerprint, which is like itself only (likeness 1) and like no other (0).  Every row gives a row, repeated
ones too, and an empty table an empty one; other columns pass through ``add_fingerprints`` as they are and are not read by ``fingerprint_documents``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import computed, split_words

SAMPLES = 64
PIECE = 2048
_MIX, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def word_hashes(text: Column) -> Column:
    """A 64-bit hash of every word."""
    return F.transform(split_words(text), lambda w: F.xxhash64(w))


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def term_hashes(words: np.ndarray, width: int = 2) -> np.ndarray:
    """A 64-bit hash for every run of ``width`` words; of the whole sequence where there are fewer words."""
    words = words.view(np.uint64)
    n = max(len(words) - width + 1, min(len(words), 1))
    runs = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        runs = _scrambled(runs + words[k : k + n])
    return runs


def _shared(bags: list[np.ndarray]) -> int:
    """With how many equal terms all bags start."""
    n = min(map(len, bags))
    same = np.ones(n, bool)
    for bag in bags[1:]:
        same &= bag[:n] == bags[0][:n]
    return n if same.all() else int(same.argmin())


def _least(terms: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """For each sample the least product of a term and the sample's odd factor; the product stands for term and e1."""
    best = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(terms), PIECE):
        np.minimum(best, (factors * terms[k : k + PIECE]).min(1), out=best)
    return best


def _e1(products: np.ndarray) -> np.ndarray:
    return -np.log1p(-((products >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)


def _repeated(bag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms that occur more than once, and the logarithms of their weights."""
    ordered = np.sort(bag)
    terms, further = np.unique(ordered[1:][ordered[1:] == ordered[:-1]], return_counts=True)
    return terms, np.log1p(np.log1p(further))


def sampled(bags: list[np.ndarray], factors: np.ndarray) -> list[np.ndarray]:
    """The samples of each bag of term hashes, as numbers of 16 bits; ``factors`` is a column of odd numbers, one a sample."""
    shared = _shared(bags)
    common, out = _least(bags[0][:shared], factors), []
    for bag in bags:
        chosen = np.minimum(common, _least(bag[shared:], factors))
        best = _e1(chosen)
        terms, logs = _repeated(bag)
        for k in range(0, len(terms), PIECE // 8):
            products = factors * terms[k : k + PIECE // 8]
            more, e1 = _scrambled(products), _e1(products)
            e2, u = -np.log(((more >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32), ((more & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) * 2.0**-32
            above = np.log1p(e2 / e1)
            step = above - np.log(u)
            points = np.floor((logs[k : k + PIECE // 8] - above) / step) + 1
            values = e1 * np.exp(-step * points)
            least = values.argmin(1)[:, None]
            value = np.take_along_axis(values, least, 1)[:, 0]
            better = value <= best
            best[better] = value[better]
            new = np.take_along_axis(products, least, 1)[:, 0] + np.take_along_axis(points, least, 1)[:, 0].astype(np.uint64) * _MIX
            chosen[better] = new[better]
        out.append((_scrambled(chosen) & np.uint64(0xFFFF)).astype(np.uint16))
    return out


def _printer(samples: int, seed: int, width: int):
    factors = (_scrambled(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1))[:, None]

    def of(*words: np.ndarray | None) -> tuple[str, ...]:
        bags = [term_hashes(np.asarray([] if w is None else w, np.int64), width) for w in words]
        made = iter(sampled([b for b in bags if len(b)], factors) if any(map(len, bags)) else ())
        return tuple(next(made).astype(">u2").tobytes().hex() if len(b) else "" for b in bags)

    return of


def add_fingerprints(rows: DataFrame, columns: dict[str, str], *, samples: int = SAMPLES, seed: int = 0, width: int = 2) -> DataFrame:
    """``rows`` with each array of word hashes (a key of ``columns``) replaced by the fingerprint of its text (the column that it names)."""
    return computed(rows, list(columns), ", ".join(f"{to} string" for to in columns.values()), lambda: _printer(samples, seed, width))


def likeness(a: Column, b: Column) -> Column:
    """Share of the samples in which two fingerprints agree."""
    split = lambda c: F.filter(F.split(c, "(?<=\\G.{4})"), lambda x: x != "")
    agree = F.aggregate(F.zip_with(split(a), split(b), lambda x, y: (x == y).cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(agree / (F.length(a) / 4))


def fingerprint_documents(docs: DataFrame, *, samples: int = SAMPLES, seed: int = 0, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint of every row."""
    return add_fingerprints(docs.select(id_col, word_hashes(F.col(text_col)).alias("_words")), {"_words": "fingerprint"}, samples=samples, seed=seed, width=width)
