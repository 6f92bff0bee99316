"""Byte-level BPE encoding and decoding by tree reduction.

A text is a sequence over a monoid: the encoding of ``a + b`` is made from the encodings of ``a`` and ``b``.  Two trees are reduced, one inside the other: ``parts`` halves a
text until a part has ``LEAF`` characters, and ``tokens`` halves each match of the pattern, as bytes, until a part has ``BYTES`` bytes.  Neighbours are joined on the
way up.  Only what stands at a seam can change, and it is redone in a window that grows until what is outside is proven stable:

* The matches of the pattern.  Where a match starts decides all later ones, and a match is certain once two characters follow
  it (the longest look-ahead is a contraction of three characters).  The window starts after the last certain match of the left part
  and grows to the right until one of its certain matches ends where a match of the right part starts.
* The tokens of one match.  A token sequence is the encoding of its bytes exactly if
  every two neighbours are the encoding of their joint bytes, so a window of tokens around the seam is re-encoded and grows until
  its outer tokens and their outer neighbours form such pairs.

The ids of a match are remembered, of at most twice ``REMEMBERED`` matches a task, since most matches are frequent words.  Decoding goes up the same tree and concatenates bytes.  The proof of the first step holds
for patterns without look-behind that look at most two characters past a match, as the one of the driver's tables does; ``Encoder`` refuses a pattern with a look-behind.  No tokenizer library
is called; the tests compare with one.

Texts are cut inside the task that holds the row, and a row's memory is a small multiple of its text.  Null counts as empty text: no ids, empty bytes.  Every row gives a row, repeated
ones too, and an empty table an empty one; columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import computed

#: Characters of a text, and bytes of a match, that are encoded without being halved.
LEAF, BYTES = 512, 16
#: Long matches are cut at multiples of this, so that the two halves of a run of one character agree in phase and their seam is stable at once.
EVEN = 192
REMEMBERED = 200_000
#: Bytes from which on merging keeps its candidates in a heap.
LONG = 64
#: Characters that must follow a match to make it certain.
AHEAD = 2


class Encoder:
    """Encodes and decodes by a table of ranks; ``pattern`` cuts a text into the matches that are encoded separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if regex.search(r"\(\?<[=!]|\\[bBG]", pattern):
            raise ValueError("the seams of a pattern that looks back are not proven")
        self.ranks, self.bytes_of, self.matches = ranks, {n: b for b, n in ranks.items()}, regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.written = [str(i) for i in range(max(ranks.values(), default=-1) + 1)]

    def merged(self, piece: bytes) -> list[int]:
        """The ids of a piece: the neighbours whose joint bytes have the least rank are merged, leftmost first, until none has a rank."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > LONG:
            return self.merged_by_heap(piece)
        rank, none = self.ranks.get, len(self.ranks)
        ends = list(range(len(piece) + 1))
        scores = [rank(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while scores and (best := min(scores)) < none:
            at = scores.index(best)
            del ends[at + 1], scores[at]
            if at < len(scores):
                scores[at] = rank(piece[ends[at] : ends[at + 2]], none)
            if at:
                scores[at - 1] = rank(piece[ends[at - 1] : ends[at + 1]], none)
        return [self.ranks[piece[i:j]] for i, j in zip(ends, ends[1:], strict=False)]

    def merged_by_heap(self, piece: bytes) -> list[int]:
        """The same for a long piece: candidates in a heap, parts as a linked list."""
        rank, n = self.ranks.get, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or after[j] != end:
                continue  # one of the two has been merged since
            alive[j], after[i] = 0, end
            if end < n:
                before[end] = i
                if (r := rank(piece[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (k := before[i]) >= 0 and (r := rank(piece[k:end])) is not None:
                heapq.heappush(heap, (r, k, end))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def tokens(self, piece: bytes) -> list[int]:
        """The ids of a piece of one match, of any length."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(piece) <= BYTES:
            return self.merged(piece)
        half = len(piece) // 2
        half = half // EVEN * EVEN or half
        return self.joined_tokens(self.tokens(piece[:half]), self.tokens(piece[half:]))

    def stable(self, a: int, b: int) -> bool:
        return self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def joined_tokens(self, left: list[int], right: list[int]) -> list[int]:
        reach = 2
        while True:
            x, y = min(reach, len(left)), min(reach, len(right))
            window = self.merged(b"".join(map(self.bytes_of.__getitem__, left[len(left) - x :] + right[:y])))
            if (x == len(left) or self.stable(left[-x - 1], window[0])) and (y == len(right) or self.stable(window[-1], right[y])):
                return left[: len(left) - x] + window + right[y:]
            reach *= 2

    def encode(self, text: str) -> list[int]:
        known, ids = self.known, []
        for match in self.parts(text):
            found = known.get(match)
            if found is None:
                found = self.older.get(match) or self.tokens(match.encode("utf-8"))
                if len(match) <= LONG:
                    if len(known) >= REMEMBERED:  # what was met since stays at hand, the rest goes
                        self.older, known = known, {}
                        self.known = known
                    known[match] = found
            ids += found
        return ids

    def parts(self, text: str) -> list[str]:
        """The matches of the whole text, joined up the tree."""
        if len(text) <= LEAF:
            return self.matches(text)
        half = len(text) // 2
        return self.joined_parts(self.parts(text[:half]), self.parts(text[half:]))

    def joined_parts(self, left: list[str], right: list[str]) -> list[str]:
        keep, behind = len(left), 0
        while keep and behind < AHEAD:  # these matches of the left part may yet change
            keep -= 1
            behind += len(left[keep])
        tail, reach = "".join(left[keep:]), 4
        while True:
            window = self.matches(tail + "".join(right[:reach]))
            if reach >= len(right):
                return left[:keep] + window
            starts, at = {}, len(tail)
            for k, part in enumerate(right[:reach]):
                starts[at] = k
                at += len(part)
            end, seen = at, 0
            for n, part in enumerate(window):
                seen += len(part)
                if seen + AHEAD > end:
                    break
                if seen in starts:
                    return left[:keep] + window[: n + 1] + right[starts[seen] :]
            reach *= 2

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of their decimal text joined by commas, SHA-256 of their bytes."""
        ids = self.encode(text)
        written = ",".join(map(self.written.__getitem__, ids))
        return len(ids), hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Encoder(ranks, pattern)


def encode_documents(docs: DataFrame, *, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids array<int>, decoded binary of every row; ``path`` is a table of ranks that every worker has."""

    def make():
        e = encoder(path, pattern)
        return lambda text: (ids := e.encode(text or ""), e.decode(ids))

    return computed(docs.select(id_col, F.col(text_col).alias("_text")), ["_text"], "ids array<int>, decoded binary", make)


def encoding_digests(docs: DataFrame, *, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256: as ``encode_documents``, without moving ids and bytes."""

    def make():
        e = encoder(path, pattern)
        return lambda text: e.digests(text or "")

    return computed(docs.select(id_col, F.col(text_col).alias("_text")), ["_text"], "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
