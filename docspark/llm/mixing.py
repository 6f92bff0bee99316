"""Mixing sources to target weights by subset-sum budget fitting.

Targets: sources, in code-point order with null last, take the weights in turn and share ``share`` times all words; a target stops at ``repeat`` times
its source's words and the excess is shared anew by weight, which ends at one level: target = min(limit, level * weight).

Choice: whole rounds of a source are taken while they fit.  For the rest the documents of a source are counted by exact length.  Every length gives
its share of the budget, rounded down; one more of some lengths brings the rest near ``DEPTH`` times the greatest length; there bounded-knapsack
dynamic programming (sums as bits of an integer, a length with its remaining count as 1, 2, 4, ... copies) finds the reachable sum nearest to the
budget.  A source's table has one row per distinct length, however many documents it has, so it is fitted in one task.

Of each length the chosen number of documents is taken in the order of a seeded hash.  The order is found in 256 slices of the hash range
by their counts, so no task ranks a whole source or length.  Between jobs only (id, source, length, hashes) moves, and once the columns to keep, if any.
The hash is of the id, of the text where there is no id.

Null texts have length 0 and are taken 0 times, empty ones too; null is a source of its own.  Repeated rows are ranked as rows of their own. Reruns agree.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import SPACE, cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEAT = 2
DEPTH = 4


def source_targets(sources: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """source, source_size, target of a table with a row per source."""
    in_turn = Window.orderBy(F.col("source").isNull(), "source")
    every = Window.partitionBy()
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(in_turn) - 1) % len(weights))
    rows = sources.select("source", "source_size", w.alias("weight")).withColumns({"limit": F.col("source_size") * float(repeat), "budget": F.sum("source_size").over(every) * share})
    rows = rows.withColumns({"level": F.col("limit") / F.col("weight"), "weights": F.sum("weight").over(every)})
    below = Window.orderBy("level").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"limits_below": F.sum("limit").over(below), "weights_below": F.sum("weight").over(below)})
    rows = rows.withColumn("stops", F.col("limits_below") + F.col("level") * (F.col("weights") - F.col("weights_below")) <= F.col("budget"))
    stopped = lambda c: F.coalesce(F.sum(F.when(F.col("stops"), F.col(c))).over(every), F.lit(0.0))
    level = (F.col("budget") - stopped("limit")) / F.nullif(F.col("weights") - stopped("weight"), F.lit(0.0))
    return rows.select("source", "source_size", F.when(F.col("stops"), F.col("limit")).otherwise(F.least("limit", level * F.col("weight"))).alias("target"))


def fitted(lengths: list[int], counts: list[int], budget: float) -> list[int]:
    """How many of each length to take, at most ``counts``, so that their sum is near the budget."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    order = sorted(range(len(lengths)), key=lambda k: lengths[k])
    taken = [0] * len(lengths)
    for k in order:
        taken[k] = int(counts[k] * (budget / total))
    rest = budget - sum(lengths[k] * taken[k] for k in order)
    depth = DEPTH * max(lengths)
    for k in reversed(order):
        if rest <= depth:
            break
        more = min(counts[k] - taken[k], 1, int(rest // lengths[k]))
        taken[k] += more
        rest -= more * lengths[k]
    goal = round(rest)
    width = goal + max(lengths) + 1
    mask = (1 << width) - 1
    reach, steps = 1, []
    for k in reversed(order):
        copies, left = 1, counts[k] - taken[k]
        while left and lengths[k] * copies < width and not reach >> goal & 1:
            copies = min(copies, left)
            steps.append((k, copies, reach))
            reach |= reach << lengths[k] * copies & mask
            left -= copies
            copies *= 2
    at = next(x for d in range(width) for x in (goal - d, goal + d) if x >= 0 and reach >> x & 1)
    for k, copies, before in reversed(steps):
        if not before >> at & 1:
            taken[k] += copies
            at -= lengths[k] * copies
    return taken


def mix_sources(
    docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: tuple[str, ...] | None = None
) -> DataFrame:
    """id_col, size, source_size, target, taken (words, repeats counted) of every row.

    With ``keep`` the columns of that name come in a struct ``row`` in place of the id, so that no join back by id is needed.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    pieces = F.size(F.split(text, SPACE))
    size = pieces - text.rlike(r"^[\x20\x09-\x0D]").cast("int") - text.rlike(r"[\x20\x09-\x0D]\z").cast("int")
    size = F.when(text.rlike(r"[^\x20\x09-\x0D]"), size).otherwise(0).cast("long")
    text_hash = F.xxhash64(text_col)
    h = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(seed), text_hash)).otherwise(F.xxhash64(F.lit(seed), F.col(id_col)))
    carried = [] if keep is None else [F.struct(*keep).alias("row")]
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), h.alias("hash"), text_hash.alias("text_hash"), *carried)
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    rows = cut(rows) if keep is None else rows  # whole rows are not written once more, the sizes are computed twice
    sliced = rows.withColumn("slice", F.shiftright("hash", 56))
    per_slice = cut(sliced.groupBy("key", "source", "size", "slice").agg(F.count("*").alias("n")))
    per_length = per_slice.groupBy("key", "source", "size").agg(F.sum("n").alias("n"))
    targets = source_targets(per_length.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights=weights, share=share, repeat=repeat)
    targets = cut(targets.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size").reset_index(drop=True)
        words, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        rounds = min(int(target // words), repeat) if words else 0
        some = rows["size"] > 0
        extra = fitted(rows["size"][some].astype(int).tolist(), rows["n"][some].astype(int).tolist(), target - rounds * words) if some.any() and rounds < repeat else 0
        rows["extra"] = 0
        rows.loc[some, "extra"] = extra
        return rows[["key", "size", "extra"]].assign(rounds=rounds)

    plan = per_length.join(targets, "key").groupBy("key").applyInPandas(fit, "key string, size long, extra long, rounds int")
    up_to = Window.partitionBy("key", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = per_slice.select("key", "size", "slice", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("before"))
    slices = cut(slices.join(plan, ["key", "size"]).join(targets, "key").select("key", "size", "slice", "before", "extra", "rounds", "source_size", "target"))
    rank = F.row_number().over(Window.partitionBy("key", "size", "slice").orderBy("hash", "id", "text_hash"))
    placed = sliced.withColumn("rank", rank).join(slices, ["key", "size", "slice"])
    taken = F.col("size") * (F.col("rounds") + (F.col("before") + F.col("rank") <= F.col("extra")).cast("int"))
    return placed.select(F.col("id").alias(id_col) if keep is None else "row", "size", "source_size", "target", taken.cast("long").alias("taken"))
