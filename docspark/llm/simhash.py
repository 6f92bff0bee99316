"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has 64 bits: bit b is set if it is set in over half of the hashes of the text's word shingles.  Two texts are
linked if their fingerprints differ in at most ``radius`` (2) bits; a class is all that links reach.

* Copies first meet by equal fingerprint, summed up before the shuffle, so a group of copies of any size is one fingerprint from there on.
* Two fingerprints that differ in 2 bits agree in at least 2 of 4 blocks of 16 bits, so each is filed under the 6 pairs of its blocks; only
  fingerprints in one file are compared.  This loses no link.
* A file is dealt into blocks of at most about ``BLOCK`` fingerprints, and every two of its blocks meet in a group of their own, so no
  task gets a file whole.
* In a group the fingerprints are stored as 64 vertical bit planes.  For each distance d along the planes all lanes (i, i + d) are
  compared at once: XOR of a plane with itself moved by d, added to carry-save counters (ones, twos, and a mask of what exceeds the
  radius); the distance is abandoned as soon as no lane is left.  A group gives its classes as a spanning star, not as pairs.
* The stars are joined across groups by label propagation with pointer jumping, on fingerprints, each round written to the checkpoint folder.

``similar_classes`` does the same for a similarity of shingle sets, with longer fingerprints and a wider radius, and then compares the sets themselves.

Null texts count as empty; a text without words has fingerprint zero and links like any other.  Repeated rows get a row each.
Ids may be null; the class of a class without any id is null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import computed, cut, lower_ascii, split_words

RADIUS = 2
BLOCK = 2048
#: Rows whose files are compared together, if they are small.
LANES = 16384
#: Bits of the longer fingerprints; the least number of drawn bits by which they are filed, the fingerprints that a file should hold, and the share of pairs that no file may hold together.
WIDE, FILE_BITS, PER_FILE, MISSED = 256, 12, 1024, 2.2e-4
#: Files up to which the sizes of those of more than one block are broadcast.
FEW = 1 << 19
#: Standard deviations of a pair's distance that the wider radius adds to the mean.
SPREAD = 4.5
#: Texts of so few shingles are filed by their shingles as well; their bits differ by more than the angle says.
SHORT = 24
#: Texts of a block when candidates are compared by their shingles.
VERIFY = 512
SALTS = np.random.default_rng(1).integers(0, 2**64, 16, dtype=np.uint64)


def shingle_hashes(text: Column, width: int = 3) -> Column:
    """XXH64 (seed 42) of every run of ``width`` lower-cased words; of the whole sequence where there are fewer, none for no words."""
    words = split_words(lower_ascii(text))

    def hashes(ws: Column) -> Column:
        n = F.size(ws)
        run = lambda w, i: F.xxhash64(F.concat_ws(" ", w, *[F.get(ws, i + k) for k in range(1, width)]))
        return F.slice(F.transform(ws, run), 1, F.greatest(n - (width - 1), F.least(n, F.lit(1))))

    return F.element_at(F.transform(F.array(words), hashes), 1)


def majority_bits(hashes: np.ndarray | None) -> int:
    """The fingerprint of an array of hashes; 0 for none."""
    if hashes is None or not len(hashes):
        return 0
    h, counts = np.asarray(hashes, np.int64).view(np.uint8).reshape(-1, 8), np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):
        counts += np.unpackbits(h[k : k + 4096], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint of every row."""

    rows = docs.select(F.col(id_col).alias("id"), shingle_hashes(F.col(text_col), width).alias("hashes"))
    return computed(rows, ["hashes"], "fingerprint long", lambda: lambda h: (majority_bits(h),))


def compared(bits: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For every row of ``bits`` (0 or 1) the first index of its class among those of its group; rows of a group stand together."""
    n = len(bits)
    label = np.arange(n)
    planes = [int.from_bytes(np.packbits(bits[:, b], bitorder="little").tobytes(), "little") for b in range(bits.shape[1])]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    left = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n])) - np.arange(n)  # rows of the group from here on

    def find(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for d in range(1, int(left.max(initial=1))):
        open_ = left > d
        open_[: n - d] &= label[: n - d] != label[d:]  # lanes within one class need no comparison
        alive = int.from_bytes(np.packbits(open_, bitorder="little").tobytes(), "little")
        if not alive:
            continue
        counters = [0] * (radius.bit_length() + 1)  # carry-save: weights 1, 2, 4, ...; the last is never cleared
        for k, plane in enumerate(planes):
            carry = plane ^ (plane >> d)
            for c in range(len(counters) - 1):
                if not carry:
                    break
                counters[c], carry = counters[c] ^ carry, counters[c] & carry
            counters[-1] |= carry
            if k >= radius:
                alive &= ~_exceeding(counters, radius)
                if not alive:
                    break
        if alive:
            near = np.flatnonzero(np.unpackbits(np.frombuffer(alive.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little"))
            for i in near.tolist():
                a, b = find(i), find(i + d)
                if a != b:
                    label[max(a, b)] = min(a, b)
            while not np.array_equal(up := label[label], label):
                label = up
    return label


def _exceeding(counters: list[int], radius: int) -> int:
    """Lanes whose count is above ``radius``: a bitwise comparison from the highest weight down."""
    over, equal = counters[-1], -1
    for k in range(len(counters) - 2, -1, -1):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            over |= equal & counters[k]
    return over


def links(fingerprints: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """Stars (a, b) that span the classes within each group of distinct ``fingerprint`` values."""
    if radius != RADIUS:
        raise ValueError("files are made for a radius of 2")
    part = lambda k: F.shiftrightunsigned("fingerprint", 16 * k).bitwiseAND(F.lit(0xFFFF))
    filed = fingerprints.select("fingerprint", F.explode(F.array(*[
        F.struct(F.lit(f).alias("f"), (part(i) * 65536 + part(j)).alias("k")) for f, (i, j) in enumerate((i, j) for i in range(4) for j in range(i))
    ])).alias("file")).select(F.col("fingerprint").alias("node"), F.col("fingerprint").alias("bits"), (F.col("file.f") * F.lit(1 << 32) + F.col("file.k")).alias("file"))
    return stars(filed, lambda column: np.unpackbits(column.to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), radius)


def stars(filed: DataFrame, unpacked, radius: int, few: bool = False) -> DataFrame:
    """Stars (a, b) of the nodes that are linked within a file; ``filed`` has node, bits and file, a row for each node and file.

    ``unpacked`` turns a series of ``bits`` into a matrix of 0 and 1.  Files with one node are dropped before anything moves twice, but with ``few``.
    With ``few`` the number of files is at most ``FEW`` and ``filed`` is read from the checkpoint folder already; only files of more than one block need their size then, at most a ``BLOCK``-th of the rows,
    so these are broadcast, no row moves to find its own, and files with one node go with the rest.
    """
    filed = filed if few else cut(filed)
    sizes = cut(filed.groupBy("file").agg(F.count("*").alias("rows")).where(F.col("rows") > (BLOCK if few else 1)))
    sized = filed.join(F.broadcast(sizes), "file", "left") if few else filed.join(sizes, "file")
    blocks = F.coalesce(F.ceil(F.col("rows") / BLOCK), F.lit(1)).cast("int")
    dealt = sized.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = dealt.select("node", "bits", "file", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    grouped = met.select("node", "bits", F.xxhash64("file", F.least("block", "other"), F.greatest("block", "other")).alias("group"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def of(rows: pd.DataFrame) -> pd.DataFrame:
            node, label = rows["node"].to_numpy(), compared(unpacked(rows["bits"]), rows["group"].to_numpy(), radius)
            linked = label != np.arange(len(label))
            return pd.DataFrame({"a": node[label[linked]], "b": node[linked]})

        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if len(rows) < LANES:
                rest = rows
                continue
            last = rows["group"].to_numpy() == rows["group"].iloc[-1]  # its group may go on
            if not last.all():
                yield of(rows[~last].reset_index(drop=True))
            rest = rows[last].reset_index(drop=True)
        if rest is not None and len(rest):
            yield of(rest)

    # Sorted by node, a class of a group is named by its least node, which is much the same in all its files: few different edges are left.
    together = grouped.repartition(F.col("group")).sortWithinPartitions("group", "node")
    return together.mapInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b); nodes of one component share a root.

    Each round points every node to its least neighbour, follows the pointers to their ends by doubling, and contracts the edges to
    those ends.  What is left shrinks by half of its nodes at least, and in stars at once, so later rounds move little.  Both sides of its joins are sorted, so no round passes a table through the driver.
    """
    left = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    total = left.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    first = True
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        forest = cut(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")))
        while True:
            ends = forest.select(F.col("node").alias("root"), F.col("root").alias("end"))
            jumped = cut(forest.join(ends.hint("merge"), "root").select("node", "root", "end"))
            forest = jumped.select("node", F.col("end").alias("root"))
            if jumped.where("root <> end").isEmpty():
                break
        ends = forest.select(F.col("node").alias("root"), F.col("root").alias("end"))
        total = forest if first else cut(total.join(ends.hint("merge"), "root", "left").select("node", F.coalesce("end", "root").alias("root")))
        first = False
        at_a, at_b = forest.select(F.col("node").alias("a"), F.col("root").alias("x")), forest.select(F.col("node").alias("b"), F.col("root").alias("y"))
        left = cut(left.join(at_a.hint("merge"), "a").join(at_b.hint("merge"), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return total


def simhash_classes(docs: DataFrame, *, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint (long), component_id (least id that links reach) of every row."""
    printed = cut(fingerprints(docs, width=width, id_col=id_col, text_col=text_col))
    first = cut(printed.groupBy("fingerprint").agg(F.min("id").alias("least_id")))
    roots = components(links(first.select("fingerprint")))
    rooted = cut(first.join(roots, first["fingerprint"] == roots["node"], "left").select("fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = cut(rooted.join(least, "root").select("fingerprint", "component_id"))
    return printed.join(classes, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "component_id")


def wide_bits(hashes: np.ndarray | None, bits: int = WIDE) -> bytes:
    """A longer fingerprint: the majority bits of the hashes and of their scrambled copies, 64 bits from each."""
    if hashes is None or not len(hashes):
        return bytes(bits // 8)
    h, counts = np.asarray(hashes, np.int64).view(np.uint64), np.zeros(bits, np.int64)
    for k in range(0, len(h), 4096):
        x = (h[k : k + 4096, None] ^ SALTS[None, : bits // 64]) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
        counts += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(h), bitorder="little").tobytes()


def wide_radius(similarity: float, bits: int = WIDE) -> int:
    """Bits in which texts of this Jaccard similarity differ on average: shingle sets have the cosine 2 J / (1 + J), and each bit differs with the share of the angle in a half turn."""
    return math.ceil(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def verified(members: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Links (a, b) that span the classes of pairs with at most ``radius`` different bits and at least this Jaccard similarity within each root.

    ``members`` has node, root, bits and the distinct shingle ``hashes`` in order.  A root's members are dealt into blocks of about ``VERIFY``, and every two
    blocks meet in a group of their own, where pairs that are in one class already are passed over.  Only links leave a group, fewer than it has rows.
    """
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / VERIFY).cast("int").alias("blocks"))
    dealt = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = dealt.select("node", "bits", "hashes", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    grouped = met.select("node", "bits", "hashes", F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("group"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, rows = None, []
        for batch in batches:
            found = []
            for row in zip(batch["group"], batch["node"], batch["bits"], batch["hashes"], strict=True):
                if row[0] != group:
                    found += linked_pairs(rows, similarity, radius)
                    group, rows = row[0], []
                rows.append(row[1:])
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])
        if found := linked_pairs(rows, similarity, radius):
            yield pd.DataFrame(found, columns=["a", "b"])

    return grouped.repartition(F.col("group")).sortWithinPartitions("group", "node").mapInPandas(run, "a long, b long").distinct()


def linked_pairs(rows: list[tuple[int, bytes, np.ndarray]], similarity: float, radius: int) -> list[tuple[int, int]]:
    """Pairs of nodes that span the classes of the links among (node, bits, hashes in order)."""
    if len(rows) < 2:
        return []
    bits = np.frombuffer(b"".join(r[1] for r in rows), np.uint64).reshape(len(rows), -1)
    sizes, label, found = np.array([len(r[2]) for r in rows]), np.arange(len(rows)), []
    for i in range(len(rows) - 1):
        rest = slice(i + 1, None)
        alike = np.minimum(sizes[rest], sizes[i]) >= similarity * np.maximum(sizes[rest], sizes[i]) - 1e-9
        near = np.flatnonzero(alike & (np.bitwise_count(bits[rest] ^ bits[i]).sum(1) <= radius) & (label[rest] != label[i])) + i + 1
        for j in near.tolist():
            if label[j] == label[i]:
                continue
            x, y = sorted((rows[i][2], rows[j][2]), key=len)
            common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            if common >= similarity * (len(x) + len(y) - common) - 1e-9:
                found.append((rows[i][0], rows[j][0]))
                label[label == label[j]] = label[i]
    return found


def filing(count: int, similarity: float) -> tuple[int, int]:
    """Number of files of a fingerprint, and their bits, for so many fingerprints: more bits keep files short, and more files then keep the share of pairs that meet in one."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = max(FILE_BITS, math.ceil(math.log2(max(1, count) / PER_FILE)))
    return math.ceil(math.log(MISSED) / math.log1p(-((1 - p) ** bits))), bits


def classes_of(docs: DataFrame, *, width: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """id, text_hash and the class's ``least`` (null_id, id, text_hash) of every row."""

    def print_of(hashes):
        few = np.asarray([] if hashes is None else hashes, np.int64)
        prefix = len(few) - math.ceil(similarity * len(few) - 1e-9) + 1 if 0 < len(few) <= SHORT else 0
        return wide_bits(hashes), few[:prefix].tolist()

    distinct = F.array_sort(F.array_distinct(shingle_hashes(F.col("text"), width)))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    printed = cut(computed(texts.select("id", "text_hash", distinct.alias("hashes")), ["hashes"], "bits binary, prefix array<long>", lambda: print_of))
    least = F.min(F.struct(F.col("id").isNull().alias("null_id"), "id", "text_hash")).alias("least")
    first = cut(cut(printed.groupBy("bits").agg(least, F.min("prefix").alias("prefix"))).withColumn("node", F.monotonically_increasing_id()))
    files, file_bits = filing(first.count(), similarity)
    drawn = np.stack([np.random.default_rng(k).choice(WIDE, file_bits, replace=False) for k in range(files)])
    weights = 1 << np.arange(file_bits, dtype=np.int64)

    def files_of(bits: bytes, prefix: np.ndarray) -> tuple[list[int]]:
        x = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(np.int64)
        return ((x[drawn] @ weights + (np.arange(files) << 32)).tolist() + ((files << 32) + np.unique(prefix % 2**file_bits)).tolist(),)

    some = first.where(F.col("bits") != F.lit(bytes(WIDE // 8)))  # texts without words are equal, and like no other
    filed = cut(computed(some.select("node", "bits", F.col("bits").alias("_in"), "prefix"), ["_in", "prefix"], "files array<long>", lambda: files_of))
    unpacked = lambda column: np.unpackbits(np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1), axis=1, bitorder="little")
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    radius = wide_radius(similarity) + round(SPREAD * math.sqrt(WIDE * p * (1 - p)))
    near = components(stars(filed.select("node", "bits", F.explode("files").alias("file")), unpacked, radius, few=(files + 1) << file_bits <= FEW))
    chosen = near.join(first, "node").select("node", "root", "bits", F.col("least.id").alias("_id"), F.col("least.text_hash").alias("_text_hash"))
    here = texts.join(chosen, texts["id"].eqNullSafe(chosen["_id"]) & (texts["text_hash"] == chosen["_text_hash"]))
    members = cut(here.dropDuplicates(["node"]).select("node", "root", "bits", distinct.alias("hashes")))
    roots = components(verified(members, similarity, radius))
    rooted = cut(first.join(roots, "node", "left").select("bits", "least", F.coalesce("root", "node").alias("root")))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("least"))
    return printed.join(cut(rooted.select("bits", "root").join(of_root, "root").select("bits", "least")), "bits").select("id", "text_hash", "least")


def similar_classes(
    docs: DataFrame, *, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id_col, component_id of every row: classes that links of texts reach whose sets of shingles of ``width`` words have at least this Jaccard similarity.

    A radius of 2 in 64 bits finds only texts that are almost equal (0.97 and up), so candidates are found by fingerprints of ``WIDE`` bits, a radius for the similarity and
    ``SPREAD`` standard deviations, and files of drawn bits; within a file no candidate is lost.  Number and bits of the files follow from the number of fingerprints (``filing``), so a file
    holds about ``PER_FILE`` at any corpus size and the share of pairs that share no file stays ``MISSED``.  Texts of at most ``SHORT`` shingles are
    also filed by their least shingles, so many that two sets of this similarity share one.  Simulated, a lone pair of similarity 0.8 is a candidate with probability 0.99 or more
    (README).  Candidates that hang together are then compared by their shingles themselves (one text for each distinct fingerprint), so no link is below the similarity.
    """
    rows = classes_of(docs, width=width, similarity=similarity, id_col=id_col, text_col=text_col)
    return rows.select(F.col("id").alias(id_col), F.col("least.id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, *, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of similar texts: that of its least id, and of the least hash of the text under this id; rows that repeat both are one document and keep one row.

    Rows without an id stay.
    """
    classes = classes_of(docs, width=width, similarity=similarity, id_col=id_col, text_col=text_col)
    least = (F.col("id") == F.col("least.id")) & (F.col("text_hash") == F.col("least.text_hash"))
    keep = classes.where(least).select(F.col("id").alias(id_col), F.col("text_hash").alias("_text_hash")).distinct()
    with_id = docs.withColumn("_text_hash", F.xxhash64(text_col)).join(keep, [id_col, "_text_hash"], "left_semi").dropDuplicates([id_col, "_text_hash"])
    return with_id.select(docs.columns).union(docs.where(F.col(id_col).isNull()))
