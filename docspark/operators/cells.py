"""Cells of vectors: every vector belongs to its nearest centre, with its distance to it, which bounds what lies in a cell without looking at it.

The centres are a sample of the vectors of stated size; they settle how tight the bounds are and nothing else.  Cells are packed into blocks of bounded size by rings of the distance, so a large cell
is many blocks.  Only the centres and the sizes of cells and rings pass through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docspark.sources.scratch import kept

#: Vectors of a block, most centres, and rings of a cell.
BLOCK, MOST_CELLS, RINGS = 1024, 1024, 8
#: Rows that are worked on at a time where each is held against every centre and may go to every cell.
AT_ONCE = 256


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long arrays of numbers, without a Python object for any of them."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def mapped(df: DataFrame, schema: T.StructType | str, of: Callable[[pa.RecordBatch], dict], *, most: int = AT_ONCE) -> DataFrame:
    """``of`` gives the columns of ``schema`` from at most ``most`` rows at a time, at least one; so what a task holds does not depend on how many rows Spark puts into a batch."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                made = of(batch.slice(at, most))
                yield pa.RecordBatch.from_arrays([x if isinstance(x := made[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def groups(batches: Iterator[pa.RecordBatch], key: str = "group") -> Iterator[pa.Table]:
    """The rows of each key, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if held and held[-1].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(starts, starts[1:], strict=False):
            held.append(batch.slice(a, b - a))
            if b < len(keys):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1), 0))


def largest(unit: bool, near: np.ndarray, norm: np.ndarray, far: np.ndarray | float) -> np.ndarray:
    """The largest product with a query that a vector can have which is at most ``far`` from a centre, given the query's length and its product ``near`` with the centre."""
    bound = near + norm * far
    if not unit:
        return bound
    # Angles obey the triangle inequality, too, and bound unit vectors more closely.
    safe = np.where(norm > 0, norm, 1)
    gap = np.arccos(np.clip(near / safe, -1, 1)) - 2 * np.arcsin(np.minimum(far / 2, 1))
    return np.minimum(bound, norm * np.cos(np.maximum(gap, 0)))


@dataclass(frozen=True)
class Cells:
    #: A row for each centre.
    centres: np.ndarray
    #: The vectors' columns, ``cell``, ``far``, the distance to its centre, and ``norm``; in the shared folder.
    members: DataFrame
    #: Vectors of each cell, and the largest ``far``.
    sizes: np.ndarray
    radii: np.ndarray
    #: Whether all vectors have the length 1.
    unit: bool

    @classmethod
    def fit(cls, vectors: DataFrame, *, id_col: str, vector_col: str = "vector", most: int = MOST_CELLS) -> Cells:
        """``vectors``, a table that is cheap to read again, has unique ids and vectors of one length (array<double>); as many centres as the root of their number, at most ``most``, those of the least hash of the id."""
        count = min(most, math.isqrt(vectors.count()) or 1)
        sample = vectors.orderBy(F.xxhash64(id_col), id_col).limit(count).select(vector_col).collect()
        centres = np.unique(np.array([r[0] for r in sample], np.float64), axis=0) if sample else np.zeros((0, 0))
        schema = T.StructType([*vectors.schema.fields, *T.StructType.fromDDL("cell int, far double, norm double").fields])

        def assigned(batch: pa.RecordBatch) -> dict:
            x = matrix(batch.column(vector_col))
            cell = distances(x, centres).argmin(1)
            return {**dict(zip(batch.schema.names, batch.columns, strict=True)), "cell": cell, "far": np.sqrt(((x - centres[cell]) ** 2).sum(1)), "norm": np.sqrt((x**2).sum(1))}

        members = kept(mapped(vectors, schema, assigned))
        sizes, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
        unit = True
        for r in members.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max(F.abs(F.col("norm") - 1)).alias("off")).collect():  # a row for each centre
            sizes[r["cell"]], radii[r["cell"]], unit = r["n"], r["far"], unit and r["off"] < 1e-9
        return cls(centres, members, sizes, radii, unit)

    def blocks(self, columns: dict[str, str], *, id_col: str, vector_col: str = "vector", block: int = BLOCK) -> DataFrame:
        """cell, far (largest of the block), an array for each of ``columns`` (name: column) and ``flat``, the vectors one after the other; about ``block`` vectors a row."""
        rows = self.sizes
        per_cell = self.members.sparkSession.createDataFrame([(c, float(r), int(min(RINGS, -(-n // block)))) for c, (n, r) in enumerate(zip(rows, self.radii, strict=True))], "cell int, radius double, rings int")
        # At most as many rows as there are centres, and centres times rings.
        ringed = self.members.join(F.broadcast(per_cell), "cell").withColumn("ring", F.least(F.col("rings") - 1, F.floor(F.when(F.col("radius") > 0, F.col("far") / F.col("radius") * F.col("rings")).otherwise(0)).cast("int")))
        counts = ringed.groupBy("cell", "ring").agg(F.ceil(F.count("*") / block).cast("int").alias("pieces"))
        placed = ringed.join(F.broadcast(counts), ["cell", "ring"]).withColumn("piece", F.pmod(F.xxhash64(id_col), F.col("pieces")).cast("int"))
        row = F.struct(*[F.col(c).alias(name) for name, c in columns.items()], F.col(vector_col).alias("v"))
        packed = placed.groupBy("cell", "ring", "piece").agg(F.max("far").alias("far"), F.collect_list(row).alias("rows"))
        field = lambda name: F.transform("rows", lambda r: r[name])
        return packed.select("cell", "far", *[field(name).alias(name) for name in columns], F.flatten(field("v")).alias("flat"))

