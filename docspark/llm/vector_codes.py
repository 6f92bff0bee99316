"""Vector code compression: product codes from codebooks that active-entry Lloyd rounds improve.

Components become integers, floor(4096 x), so every distance, sum and tie is exact.  Vectors are cut into equal consecutive parts; the codebook of a part position starts as that part of
the first kept vectors by id.  A round assigns every part to the nearest entry (squared distance, ties to the lower index) and moves each entry to the floor of its parts' mean.

Each row carries its parts' entries and exact distances from round to round.  A part whose entry did not move knows that no other entry that stayed is nearer (or as near with a lower
index), so it is compared with the moved entries only; the other parts are compared with all.  ``compared`` counts those comparisons.

A round is one pass over a table in the shared checkpoint folder, which it writes anew: the rows with their new entries, and one row of sums for each task, part and entry, which Spark adds up.
Only the sums of a codebook (parts x entries rows) reach the driver.  A lost executor costs tasks of one round.

Rows whose vector is null or holds a null or non-finite component are dropped.  Vectors shorter than the longest, or than a multiple of the parts, count as filled up with zeros; an empty vector is
all zeros.  Components beyond 32,768 either way saturate, so that errors fit in a long.  Rows that repeat an id are rows of their own, also among the first vectors, where equal ids follow each other by
their components and null ids come last.  With fewer vectors than entries the codebooks are shorter; an empty table gives an empty one.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docspark.llm.common import Rounds, cut

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest integer component; eight parts of eight squared differences of twice this fit in a long.
LARGEST = 1 << 27
#: Rows that are compared at a time.
SLICE = 4096

_STATE = "x array<int>, entries array<int>, distances array<bigint>"
_SUMS = "part int, entry int, n bigint, total array<bigint>, compared bigint"


@dataclass(frozen=True)
class Compressed:
    """``codes``: id, label, code (two hex digits a part), error; ``codebooks``: part x entry x component; ``compared``: comparisons of each assignment, the last one included."""

    codes: DataFrame
    codebooks: np.ndarray
    compared: list[int]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def integer_vectors(vectors: DataFrame, *, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """id, label, x (integers) of the vectors that are whole and finite."""
    x = F.col(vector_col)
    whole = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))  # Spark orders NaN above infinity
    to_int = lambda v: F.greatest(F.least(F.floor(v.cast("double") * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int")
    return vectors.where(whole).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(x, to_int).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` numbers, filled up with zeros."""
    at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    if (np.diff(at) == width).all():
        return values[at[0] : at[-1]].astype(np.int64).reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    for row, a, b in zip(out, at, at[1:], strict=False):
        row[: b - a] = values[a:b]
    return out


def nearest(x: np.ndarray, book: np.ndarray, moved: np.ndarray, entry: np.ndarray | None, distance: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entries of one part of some rows, their squared distances, and how many comparisons it took.

    ``entry`` and ``distance`` are those against the book before the entries ``moved``; without them every row is compared with every entry.
    """
    if entry is None:
        entry, distance = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
        active = np.zeros(len(x), bool)
    else:
        entry, distance, active = entry.copy(), distance.copy(), ~moved[entry]
        distance[~active] = np.iinfo(np.int64).max
    took = 0
    for e in range(len(book)):
        rows = np.arange(len(x)) if moved[e] else np.flatnonzero(~active)
        d = ((x[rows] - book[e]) ** 2).sum(1)
        took += len(rows)
        nearer = (d < distance[rows]) | ((d == distance[rows]) & (e < entry[rows]))
        entry[rows[nearer]], distance[rows[nearer]] = e, d[nearer]
    return entry, distance, took


def _assigned(batch: pa.RecordBatch, books: np.ndarray, moved: np.ndarray, first: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Slices of a batch with their parts (rows x parts x components), entries and distances, and the comparisons."""
    parts, _, width = books.shape
    for at in range(0, batch.num_rows, SLICE):
        piece = batch.slice(at, SLICE)
        x = _matrix(piece.column("x"), parts * width).reshape(-1, parts, width)
        old = (None, None) if first else (_matrix(piece.column("entries"), parts), _matrix(piece.column("distances"), parts))
        found = [nearest(x[:, p], books[p], moved[p], *[None if o is None else o[:, p] for o in old]) for p in range(parts)]
        yield piece, x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1), sum(f[2] for f in found)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel(), kind))


def _round(state: DataFrame, books: np.ndarray, moved: np.ndarray, *, first: bool) -> DataFrame:
    """The rows with their new entries and distances, and after them each task's sums."""
    own = T.StructType([f for f in state.schema.fields if f.name in ("id", "label")])
    schema = T.StructType(own.fields + T.StructType.fromDDL(f"{_STATE}, {_SUMS}").fields)
    arrow = to_arrow_schema(schema)
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, compared = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64), 0
        for batch in batches:
            for piece, x, entry, distance, took in _assigned(batch, books, moved, first):
                compared += took
                for p in range(parts):
                    np.add.at(total[p], entry[:, p], x[:, p])
                    n[p] += np.bincount(entry[:, p], minlength=entries)
                made = {"id": piece.column("id"), "label": piece.column("label"), "x": piece.column("x"), "entries": _lists(entry, pa.int32()), "distances": _lists(distance, pa.int64())}
                yield pa.RecordBatch.from_arrays([made.get(f.name, pa.nulls(piece.num_rows, f.type)) for f in arrow], schema=arrow)
        if entries and n.any():
            part, entry = np.divmod(np.arange(parts * entries), entries)
            sums = {"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(n.ravel()), "total": _lists(total.reshape(-1, width), pa.int64())}
            sums["compared"] = pa.array([compared] + [0] * (len(part) - 1), pa.int64())
            yield pa.RecordBatch.from_arrays([sums.get(f.name, pa.nulls(len(part), f.type)) for f in arrow], schema=arrow)

    return state.select("id", "label", "x", *([] if first else ["entries", "distances"])).mapInArrow(run, schema)


def _coded(state: DataFrame, books: np.ndarray, moved: np.ndarray, *, first: bool) -> DataFrame:
    """id, label, code, error, compared of each row."""
    schema = T.StructType([f for f in state.schema.fields if f.name in ("id", "label")] + T.StructType.fromDDL("code string, error bigint, compared bigint").fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, _, entry, distance, took in _assigned(batch, books, moved, first):
                codes = pa.array([bytes(row).hex() for row in entry.astype(np.uint8)], pa.string())
                compared = pa.array([took] + [0] * (piece.num_rows - 1), pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("label"), codes, pa.array(distance.sum(1)), compared], schema=arrow)

    return state.select("id", "label", "x", *([] if first else ["entries", "distances"])).mapInArrow(run, schema)


def _improved(written: DataFrame, books: np.ndarray) -> tuple[np.ndarray, int]:
    """The entries moved to the floors of their means, and the comparisons of the round."""
    width = books.shape[2]
    sums = written.where("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), F.sum("compared").alias("compared"), *[F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(width)])
    books, compared = books.copy(), 0
    for row in sums.collect():  # a row for each entry
        compared += row["compared"]
        if row["n"]:
            books[row["part"], row["entry"]] = [row[f"t{i}"] // row["n"] for i in range(width)]
    return books, compared


def compress(
    vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> Compressed:
    """Codes of all kept vectors and the codebooks after ``rounds`` rounds; at most 256 entries, as a code has two digits a part."""
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    folder = Rounds(vectors.sparkSession, "vector-codes")
    state = folder.written(integer_vectors(vectors, id_col=id_col, vector_col=vector_col, label_col=label_col, scale=scale))
    longest = state.agg(F.max(F.size("x"))).first()[0] or 0
    width = -(-longest // parts)
    start = state.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    books = np.zeros((parts, len(start), width), np.int64)
    for e, row in enumerate(start):
        filled = np.zeros(parts * width, np.int64)
        filled[: len(row["x"])] = row["x"]
        books[:, e] = filled.reshape(parts, width)
    moved, compared = np.ones(books.shape[:2], bool), []
    for k in range(rounds):
        written = folder.written(_round(state, books, moved, first=k == 0))
        better, took = _improved(written, books)
        moved, books, state = (better != books).any(2), better, written.where("part is null")
        compared.append(took)
    codes = cut(_coded(state, books, moved, first=rounds == 0))
    folder.remove()
    return Compressed(codes.drop("compared"), books, [*compared, codes.agg(F.sum("compared")).first()[0] or 0])


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the error summed over equal labels, nulls together."""
    # A decimal sum cannot overflow; what no long can hold saturates.
    summed = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    by_label = codes.groupBy(F.col("label").alias("_label")).agg(summed.alias("label_error"))
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
