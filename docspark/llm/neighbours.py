"""The next row in the order of an id, without a single-task sort.

The ids are cut into ranges at quantiles; a row that stands first in its range is also sent to the range before it (the first
of all to the last), so each range can look up its rows' successors alone.  The number of ranges follows from the bytes of the text, ``RANGE_BYTES`` each up to ``MOST_RANGES``
(200 GB), so up to there a range does not grow with the input, and beyond it is sorted with spilling; each range is a partition of its own.  Only the quantiles, as many as there are ranges, pass through the driver.  Null ids come last; all of them are
in one range, as they have no order to cut by, and so are rows that share an id.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

RANGE_BYTES = 4 << 20
MOST_RANGES = 50_000


def with_ranges(df: DataFrame, id_col: str, *, text_col: str | None = None, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, list[Column], int]:
    """``df`` with ``_range`` and ``_after`` (the copies that follow a range's own rows), the order within a range (id_col descending), and the number of ranges.

    Without ``text_col`` a row counts 64 bytes.
    """
    order = [F.col("_after"), F.col(id_col).desc_nulls_last()]
    place = -F.col(id_col).cast("double")
    ids = df.select(place.alias("place"), (F.octet_length(text_col) if text_col else F.lit(64)).alias("bytes"))
    total = ids.agg(F.min("place").alias("first"), F.sum("bytes").alias("bytes")).first()
    n = min(MOST_RANGES, max(1, -(-(total["bytes"] or 0) // range_bytes)))
    cuts = sorted(set(ids.approxQuantile("place", [i / n for i in range(n)], 0.25 / n)) | {total["first"]} - {None})
    if not cuts:  # no rows, or none with an id
        return df.select("*", F.lit(0).alias("_range"), F.lit(False).alias("_after")), order, 1
    # Range i holds the places from cuts[i] up to below cuts[i + 1]; null ids are in the last.
    bucket = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_place", outputCol="_bucket", handleInvalid="keep")
    placed = bucket.transform(df.withColumn("_place", F.coalesce(place, F.lit(float("nan")))))
    placed = placed.withColumn("_range", F.least(F.col("_bucket").cast("int") - 1, F.lit(len(cuts) - 1)))
    before = F.pmod(F.col("_range") - 1, F.lit(len(cuts)))
    own = F.struct(F.col("_range").alias("r"), F.lit(False).alias("a"))
    copies = F.when(F.col("_place").isin(cuts), F.array(own, F.struct(before.alias("r"), F.lit(True).alias("a")))).otherwise(F.array(own))
    return placed.withColumn("_copy", F.explode(copies)).select(*df.columns, F.col("_copy.r").alias("_range"), F.col("_copy.a").alias("_after")), order, len(cuts)


def window_of(order: list[Column], *ties: str) -> WindowSpec:
    return Window.partitionBy("_range").orderBy(*order, *ties)
