"""Line dedup by overlapping windows of three lines.

Every run of three consecutive lines is hashed to 128 bits; a window that occurs more than once anywhere is kept at its first place (least
id, then least line) and removed at every later one.  The lines that removed windows cover are merged and taken out of the
text.  A line that is taken out therefore still stands at an earlier place, down to a first one that stays.

Only (hash, id, hash of the text, line) moves, 40 bytes a window, and once the texts for the final join.  First places are found by an aggregation
that sums up before the shuffle; they are written to the checkpoint folder, so that the join back to all windows reads
two plain shuffles and a very frequent window is split by the engine's skew join.

Lines end at a line feed.  Windows of blank lines only are not compared; texts of fewer than three lines have no window.  Null texts stay null,
empty texts empty, an empty table gives an empty one.  Rows that share an id and a text count as one document, by a hash of the text, so repeated rows lose the same lines; a null id comes after all others, and
documents of one id, or of none, are told apart by that hash and follow each other by it.  Other columns stay as they are, whatever their names but ``lines_before`` and
``lines_removed``, which the result has anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import cut

WINDOW = 3


def text_hash(text: Column) -> Column:
    """With the id it tells documents apart; ids can be null or shared by different texts."""
    return F.xxhash64(text)


def later_windows(docs: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash, at (first line, from 0) of every window that has an equal one at an earlier place."""
    lines = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("text_hash"), F.split(F.col(text_col), "\n").alias("lines"))
    starts = lines.where(F.size("lines") >= window).select("id", "text_hash", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - window)).alias("at"))
    joint = F.concat_ws("\n", *[F.get("lines", F.col("at") + k) for k in range(window)])
    windows = starts.select("id", "text_hash", "at", joint.alias("joint")).where(F.col("joint").rlike(r"\S"))
    windows = windows.select("id", "text_hash", "at", F.xxhash64("joint").alias("hash"), F.xxhash64(F.lit(1), "joint").alias("hash2"))
    place = F.struct(F.col("id").isNull().alias("null_id"), "id", "text_hash", "at")
    first = windows.groupBy("hash", "hash2").agg(F.min(place).alias("first"), F.count("*").alias("places")).where("places > 1")
    first = cut(first.select("hash", "hash2", F.col("first.id").alias("first_id"), F.col("first.text_hash").alias("first_text"), F.col("first.at").alias("first_at")))
    same = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_text")) & (F.col("at") == F.col("first_at"))
    return windows.join(first, ["hash", "hash2"]).where(~same).select("id", "text_hash", "at")


def dedup_lines(docs: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text that is left, and the columns ``lines_before`` and ``lines_removed``."""
    later = later_windows(docs, window=window, id_col=id_col, text_col=text_col)
    starts = later.groupBy(F.col("id").alias("later_id"), F.col("text_hash").alias("later_text")).agg(F.collect_set("at").alias("starts"))
    # The row travels as one struct, so no name of its columns can meet one of the join's.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    id_, text = F.col("row").getField(id_col), F.col("row").getField(text_col)
    joined = rows.join(starts, id_.eqNullSafe(F.col("later_id")) & (text_hash(text) == F.col("later_text")), "left")
    lines = F.split(text, "\n")
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (window - 1)))))
    gone = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    kept = F.array_join(F.transform(gone, lambda i: F.get(lines, i)), "\n")
    changed = F.col("starts").isNotNull()
    own = [c for c in docs.columns if c not in ("lines_before", "lines_removed")]
    return joined.select(
        *[F.when(changed, kept).otherwise(text).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in own],
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("lines_before"),
        F.when(changed, F.size(covered)).otherwise(0).cast("long").alias("lines_removed"),
    )
