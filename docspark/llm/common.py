"""Helpers that the operators of this package share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Words of the contracts that split at ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """A table of fewer splits than cores is dealt over all cores, since texts are dear to work on; larger ones stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(c, UPPER, UPPER.lower())


def split_words(c: Column, separator: str = SPACE) -> Column:
    """The non-empty pieces between separators; null counts as empty text."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), separator), "")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session that has none gets a temporary one, elsewhere executors would not share it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (folder or tempfile.mkdtemp(prefix="docspark-")).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again, so that a lost executor costs no earlier stage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


class Rounds:
    """Tables that replace each other in the shared checkpoint folder: each is written whole before the one that it was made from goes."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def written(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.folder}/{self.n}")
        if self.n > 1:
            remove(self.spark, f"{self.folder}/{self.n - 1}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.n}")

    def remove(self) -> None:
        remove(self.spark, self.folder)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def computed(rows: DataFrame, inputs: list[str], outputs: str, make: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """``rows`` with the columns ``inputs`` replaced by ``outputs`` (DDL), computed row by row in Arrow batches.

    ``make`` runs once a task and gives the function from a row's inputs to its outputs; arrays of numbers arrive as NumPy slices.
    The other columns pass through as they are, nulls included.
    """
    kept = [f for f in rows.schema.fields if f.name not in inputs]
    made = T.StructType.fromDDL(outputs).fields
    kinds, ins, through = [to_arrow_type(f.dataType) for f in made], list(inputs), [f.name for f in kept]
    names = through + [f.name for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            # No generator: a StopIteration of ``of`` must end the task, not the batch.
            rows = [of(*row) for row in zip(*[_values(batch.column(c)) for c in ins], strict=True)]
            results = zip(*rows, strict=True)
            columns = [pa.array(list(x), type=k) for x, k in zip(results, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in through] + columns, names=names)

    return rows.mapInArrow(run, T.StructType(kept + made))


def _values(column: pa.Array) -> list:
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(at, at[1:], strict=False)]
