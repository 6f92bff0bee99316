"""Catalogue, sessions, messages, usage, evaluation and analysis over tables."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.sources.scratch import kept


def drop_duplicate_content(new: DataFrame, existing: DataFrame, *, scope: str = "session_id") -> DataFrame:
    """Rows whose content hash is new within its scope; the first of several by ``ord``. Counted by hash before any window, so copies do not pile up."""
    first = new.groupBy(scope, "content_hash").agg(F.min("ord").alias("ord"))
    fresh = first.join(existing.select(scope, "content_hash"), [scope, "content_hash"], "left_anti")
    return new.join(fresh.select(scope, "ord"), [scope, "ord"], "left_semi")


def cap_per_session(new: DataFrame, existing: DataFrame, *, max_batch: int = 7, max_total: int = 20) -> DataFrame:
    """Session, sizes and whether its whole batch is admitted."""
    batch = new.groupBy("session_id").agg(F.count("*").alias("batch"))
    there = existing.groupBy("session_id").agg(F.count("*").alias("there"))
    joined = batch.join(there, "session_id", "left").withColumn("there", F.coalesce("there", F.lit(0)))
    return joined.withColumn("admitted", (F.col("batch") <= max_batch) & (F.col("batch") + F.col("there") <= max_total))


def orphan_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    return vectors.select("paper_id").distinct().join(chunks.select("paper_id").distinct(), "paper_id", "left_anti")


def result_cache_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """First cached result by query and sorted paper ids; null on a miss."""
    key = lambda c: F.array_join(F.array_sort(c), ",")
    first = cache.groupBy("query", key(F.col("paper_ids").cast("array<string>")).alias("key")).agg(F.min_by("result", "cache_id").alias("result"))
    return requests.withColumn("key", key(F.col("paper_ids").cast("array<string>"))).join(first, ["query", "key"], "left").drop("paper_ids")


def best_tier(extracts: DataFrame, min_chars: int = 100) -> DataFrame:
    """doc_id, tier, text: the first tier whose trimmed text is long enough, else a failed row with tier null."""
    good = F.length(F.trim("text")) >= min_chars
    return extracts.groupBy("doc_id").agg(F.min_by(F.struct("tier", "text"), F.when(good, F.col("tier"))).alias("b")).select("doc_id", "b.tier", "b.text")


def papers_by_session(papers: DataFrame, status: str | None = None) -> DataFrame:
    """Papers by session and time; a sort by range, so a large session is spread."""
    return (papers if status is None else papers.where(F.col("status") == status)).orderBy("session_id", "created_at", "paper_id")


def stuck_papers(papers: DataFrame) -> DataFrame:
    return papers.where(~F.lower("status").isin("completed", "failed"))


def messages_page(messages: DataFrame, limit: int, offset: int) -> DataFrame:
    """One page of each conversation in time order, with its total."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    counted = messages.withColumns({"place": place, "total": F.count("*").over(Window.partitionBy("conv_id"))})
    return counted.where((F.col("place") > offset) & (F.col("place") <= offset + limit if limit else F.lit(True)))


def recent_messages(messages: DataFrame, turns: int = 5) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return messages.withColumn("newest", newest).where(F.col("newest") <= 2 * turns).drop("newest")


def prune_messages(messages: DataFrame, keep: int = 50) -> DataFrame:
    """conv_id, kept, removed when only the newest ``keep`` stay."""
    n = messages.groupBy("conv_id").agg(F.count("*").alias("n"))
    return n.select("conv_id", F.least("n", F.lit(keep)).alias("kept"), F.greatest(F.col("n") - keep, F.lit(0)).alias("removed"))


def owned(requests: DataFrame, papers: DataFrame) -> DataFrame:
    """Status of each requested paper: ok, forbidden (another session's) or not_found."""
    joined = requests.join(papers.select("paper_id", F.col("session_id").alias("owner")), "paper_id", "left")
    return joined.withColumn("access", F.when(F.col("owner").isNull(), "not_found").when(F.col("owner") == F.col("session_id"), "ok").otherwise("forbidden")).drop("owner")


def status_counts(papers: DataFrame) -> DataFrame:
    low = F.lower("status")
    return papers.groupBy("session_id").agg(F.count_if(low == "completed").alias("ready"), F.count_if(~low.isin("completed", "failed")).alias("active"))


def author_rows(papers: DataFrame) -> DataFrame:
    """paper_id, place, author: split at semicolons, else at " and "."""
    names = F.when(F.col("authors").contains(";"), F.split("authors", ";")).otherwise(F.split("authors", " and "))
    return papers.select("paper_id", F.posexplode(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != "")).alias("place", "author"))


# Usage and progress, as batch forms; the streaming forms are in docspark.streaming.


def progress_stage(progress: Column) -> Column:
    return F.when(progress < 0, "failed").when(progress <= 0.25, "extracting").when(progress <= 0.4, "analyzing_figures").when(progress <= 0.5, "chunking").when(progress < 1, "embedding").otherwise("completed")


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def progress_eta(events: DataFrame) -> DataFrame:
    """Adds eta_seconds: elapsed * (1 - p) / p with p held within 0.01 and 1; 0 when failed or done."""
    start = F.min("ts").over(Window.partitionBy("paper_id"))
    elapsed = _seconds(F.col("ts")) - _seconds(start)
    p = F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.col("progress")))
    return events.withColumn("eta_seconds", F.when((F.col("progress") < 0) | (F.col("progress") >= 1), 0.0).otherwise(F.round(elapsed * (1 - p) / p, 1)))


def latest_status(events: DataFrame) -> DataFrame:
    return events.groupBy("paper_id").agg(F.max_by(F.struct("progress", "event_type"), F.struct("ts", "event_id")).alias("l")).select("paper_id", "l.progress", "l.event_type")


def batch_complete(events: DataFrame, batches: DataFrame, timeout_s: float = 600.0, grace_s: float = 60.0) -> DataFrame:
    """Per batch: papers, how many completed, how many did not (both 0 while it is open), whether all are terminal, whatever the case of the status, and whether its time is up.

    ``batches`` has batch_id, paper_id and started.  Only what happened up to ``timeout_s + grace_s`` after the start counts; papers without an event do not hold a batch up, and count as not completed.
    """
    deadline = _seconds(F.col("started")) + timeout_s + grace_s
    timely = events.join(batches.select("batch_id", "paper_id", deadline.alias("_deadline")), ["batch_id", "paper_id"]).where(_seconds(F.col("ts")) <= F.col("_deadline"))
    last = timely.groupBy("batch_id", "paper_id").agg(F.max_by(F.lower("status"), F.struct("ts", "event_id")).alias("s"))
    papers = batches.select("batch_id", "paper_id").distinct().join(last, ["batch_id", "paper_id"], "left")
    done = F.every(F.col("s").isNull() | F.col("s").isin("completed", "failed"))
    counted = papers.groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if(F.col("s") == "completed").alias("n"), done.alias("done"))
    return counted.select("batch_id", "total", F.when(F.col("done"), F.col("n")).otherwise(0).alias("completed"), F.when(F.col("done"), F.col("total") - F.col("n")).otherwise(0).alias("failed"), "done", (~F.col("done")).alias("timed_out"))


def batch_completions(events: DataFrame, batches: DataFrame, timeout_s: float = 600.0, grace_s: float = 60.0) -> DataFrame:
    """batch_id, at (microseconds), total, completed, failed, done: the first moment at which all papers of a batch are settled, or else its deadline (then completed and failed are 0).

    A paper is settled while its last status is completed or failed, whatever the case, or null (it is gone, and counts as failed); before its first event it is pending.  Events of one time go by
    event_id; events of papers that are not the batch's do not count.  Only changes of a paper's state are put in order across the batch.
    """
    deadline = F.unix_micros(F.min("started").cast("timestamp")) + round((timeout_s + grace_s) * 1e6)
    known = batches.groupBy("batch_id").agg(F.countDistinct("paper_id").alias("total"), deadline.alias("deadline"))
    members = batches.select("batch_id", "paper_id").distinct().join(known, "batch_id")
    timely = events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).join(members, ["batch_id", "paper_id"]).where("at <= deadline")
    status, of_paper = F.lower("status"), Window.partitionBy("batch_id", "paper_id").orderBy("at", "event_id")
    state = F.struct((F.isnull(status) | status.isin("completed", "failed")).cast("int").alias("settled"), F.coalesce((status == "completed").cast("int"), F.lit(0)).alias("completed"))
    changes = timely.withColumn("now", state).withColumn("was", F.coalesce(F.lag("now").over(of_paper), F.struct(F.lit(0).alias("settled"), F.lit(0).alias("completed")))).where("now <> was")
    running = Window.partitionBy("batch_id").orderBy("at", "event_id", "paper_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = changes.select("batch_id", "at", "event_id", "total", *[F.sum(F.col(f"now.{c}") - F.col(f"was.{c}")).over(running).alias(c) for c in ("settled", "completed")])
    first = summed.where("settled = total").groupBy("batch_id").agg(F.min(F.struct("at", "event_id", "completed")).alias("f"))
    found = known.join(first, "batch_id", "left")
    done = F.col("f").isNotNull()
    return found.select("batch_id", F.coalesce("f.at", "deadline").alias("at"), "total", F.coalesce("f.completed", F.lit(0)).cast("long").alias("completed"), F.when(done, F.col("total") - F.col("f.completed")).otherwise(0).cast("long").alias("failed"), done.alias("done"))


def sessions_recent(sessions: DataFrame, key: str, last: str) -> DataFrame:
    """Adds ``place``: newest first (null last), ties by key.

    Rows are dealt into ranges and sorted there; a row's place is that in its range after the counts of the ranges before, of which there are as many as partitions.  The sorted rows are written to the shared
    folder first, as ranges drawn anew would not fit the counts.
    """
    order = [F.desc_nulls_last(last), F.asc_nulls_last(key)]
    rows = kept(sessions.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumns({"_range": F.shiftright("_at", 33), "_own": F.col("_at").bitwiseAND((1 << 33) - 1) + 1})
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    counts = rows.groupBy("_range").agg(F.count("*").alias("n")).select("_range", before)
    return rows.join(F.broadcast(counts), "_range").withColumn("place", F.col("_before") + F.col("_own")).drop("_at", "_range", "_own", "_before")


def _frame_sums(df: DataFrame, seconds: float, sums: dict[str, Column]) -> DataFrame:
    """Adds the sums over a provider's rows from ``seconds`` before a row's ``ts`` up to it, rows of either moment included.

    Time is cut into slices as long as the frame, and every row comes once more, as ``_copy`` and later by one frame, in the next slice.  So a frame is what its slice's own rows add up to before it and what the
    copies add up to after it: two running sums, whose cost does not grow with the rows in a frame, and which never subtract.  A provider with most of the calls is many groups, one a slice.
    """
    micros, us = int(seconds * 1_000_000), F.unix_micros(F.col("ts").cast("timestamp"))
    start = us - F.pmod(us, F.lit(micros))
    place = lambda by, copy: F.struct((start + by).alias("slice"), (us + by).alias("at"), F.lit(copy).alias("copy"))
    both = F.explode(F.when(us.isNull(), F.array(place(0, False))).otherwise(F.array(place(0, False), place(micros, True))))
    rows = df.withColumn("_in", both).withColumns({"_slice": F.col("_in.slice"), "_at": F.col("_in.at"), "_copy": F.col("_in.copy")})
    carried = [F.when(~F.col("_copy"), F.col(c)).alias(c) for c in df.columns if c != "provider"]
    values = [F.when(F.col("_copy") == copy, c).alias(f"_{name}_{copy}") for name, c in sums.items() for copy in (False, True)]
    rows = rows.select("provider", "_slice", "_at", "_copy", *carried, *values)
    upto = lambda order: Window.partitionBy("provider", "_slice").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"_{name}_False": F.sum(f"_{name}_False").over(upto(F.asc("_at"))) for name in sums})
    rows = rows.withColumns({f"_{name}_True": F.sum(f"_{name}_True").over(upto(F.desc("_at"))) for name in sums}).where("not _copy")
    total = lambda a, b: F.coalesce(a + b, a, b)
    return rows.select(*df.columns, *[total(F.col(f"_{name}_False"), F.col(f"_{name}_True")).alias(name) for name in sums])


def rolling_usage(calls: DataFrame, *, window_s: float = 60.0, day_s: float = 86_400.0) -> DataFrame:
    """Adds tokens and requests of the last window and requests of the last day, per provider; both ends count."""
    recent = _frame_sums(calls, window_s, {"tokens_window": F.col("tokens"), "requests_window": F.lit(1)})
    return _frame_sums(recent, day_s, {"requests_day": F.lit(1)})


def usage_summary(usage: DataFrame, limits: DataFrame, waits: DataFrame) -> DataFrame:
    """Tokens, requests and requests of the day of each provider at its last call, their maxima (0 without a limit; the day is null without one), and the whole seconds of cooldown left then.

    ``limits`` has provider, tpm, rpm, rpd; ``waits`` has provider and until_s, in seconds since 1970.
    """
    last = F.max_by(F.struct("ts", "tokens_window", "requests_window", "requests_day"), F.struct("ts", "event_id"))
    current = usage.groupBy("provider").agg(last.alias("l"))
    joined = current.join(limits, "provider", "left").join(waits.groupBy("provider").agg(F.max("until_s").alias("until_s")), "provider", "left")
    daily = F.when(F.coalesce("rpd", F.lit(0)) > 0, F.col("l.requests_day"))
    left = F.coalesce(F.greatest(F.lit(0.0), F.col("until_s") - _seconds(F.col("l.ts"))), F.lit(0.0)).cast("long")
    most = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        "provider", F.col("l.tokens_window").alias("tokens"), most("tpm").alias("max_tokens"), F.col("l.requests_window").alias("requests"), most("rpm").alias("max_requests"), daily.alias("day"),
        F.nullif(F.col("rpd"), F.lit(0)).alias("max_day"), left.alias("cooldown_s"),
    )


def over_budget(usage: DataFrame, limits: DataFrame, *, share: float = 0.85) -> DataFrame:
    """Adds within_budget: window tokens, requests and the day's requests stay within ``int(limit * share)``."""
    joined = usage.join(limits, "provider")
    cap = lambda c: F.floor(F.col(c) * share)
    return joined.withColumn("within_budget", (F.col("tokens_window") <= cap("tpm")) & (F.col("requests_window") <= cap("rpm")) & (F.col("requests_day") <= cap("rpd")))


def cooldowns(events: DataFrame, *, default: float = 60.0, slice_s: float = 86_400.0) -> DataFrame:
    """Adds until_s: the running maximum of event time plus the wait (at least a second); within a slice of time by rows, before it by the maxima of the slices."""
    until = _seconds(F.col("ts")) + F.greatest(F.lit(1.0), F.coalesce("retry_after", F.lit(default)))
    rows = events.withColumns({"_until": until, "_slice": F.floor(_seconds(F.col("ts")) / slice_s)})
    maxima = rows.groupBy("provider", "_slice").agg(F.max("_until").alias("_top"))
    before = maxima.select("provider", "_slice", F.max("_top").over(Window.partitionBy("provider").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = F.max("_until").over(Window.partitionBy("provider", "_slice").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = rows.withColumn("_own", own).join(before, ["provider", "_slice"])
    return joined.withColumn("until_s", F.greatest("_own", "_before")).drop("_until", "_slice", "_own", "_before")


def admit(requests: DataFrame, max_calls: int, window_s: float = 60.0, slice_s: float = 3600.0) -> DataFrame:
    """Adds admitted: fewer than ``max_calls`` admitted calls of the client in the last window; rejected calls do not count.

    Nothing carries over a pause as long as the window, so a client's calls are cut there and each run of calls is a group of its own.  The cuts are found in time slices, whose last
    calls and cuts are all that passes from one to the next.  A run's rows come sorted and in batches, and its state is the admitted times of one window, so a run of any length fits.
    """
    window, kinds = round(window_s * 1e6), "client long, event_id long, admitted boolean"
    rows = requests.select("client", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).withColumn("slice", F.floor(F.col("at") / round(slice_s * 1e6)))
    in_slice, slices = Window.partitionBy("client", "slice").orderBy("at", "event_id"), Window.partitionBy("client").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("client", "slice").agg(F.max("at").alias("end")).withColumn("end_before", F.max("end").over(slices)).drop("end")
    rows = rows.join(ends, ["client", "slice"])
    before = F.coalesce(F.lag("at").over(in_slice), "end_before")
    rows = rows.withColumn("cut", F.when(before.isNull() | (F.col("at") - before >= window), F.col("at")))
    cuts = rows.groupBy("client", "slice").agg(F.max("cut").alias("cut")).withColumn("cut_before", F.max("cut").over(slices)).drop("cut")
    run = F.coalesce(F.max("cut").over(in_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "cut_before")
    rows = rows.join(cuts, ["client", "slice"]).withColumn("run", run)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, seen = None, deque()
        for batch in batches:
            out = []
            for client, start, t in zip(batch["client"], batch["run"], batch["at"], strict=True):
                if key != (client, start):
                    key, seen = (client, start), deque()
                while seen and seen[0] <= t - window:
                    seen.popleft()
                out.append(len(seen) < max_calls)
                if out[-1]:
                    seen.append(t)
            yield batch[["client", "event_id"]].assign(admitted=out)

    return rows.select("client", "run", "at", "event_id").repartition("client", "run").sortWithinPartitions("client", "run", "at", "event_id").mapInPandas(decide, kinds)


# Evaluation.


def accuracy_by_type(labels: DataFrame, kind: str, accurate: str) -> DataFrame:
    return labels.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("claims"), F.round(F.avg(F.col(accurate).cast("double")), 6).alias("accuracy"))


def confusion(pred: DataFrame, labels: DataFrame) -> DataFrame:
    """label, prediction, n over rows with both."""
    return pred.join(labels, "doc_id").groupBy("label", "prediction").agg(F.count("*").alias("n"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    joined = a.select("doc_id", F.col("label").alias("x")).join(b.select("doc_id", F.col("label").alias("y")), "doc_id")
    return joined.agg(F.count("*").alias("pairs"), F.round(F.avg((F.col("x") == F.col("y")).cast("double")), 6).alias("agreement"))


def calibration(cases: DataFrame, least: float = 0.8) -> DataFrame:
    """Cases, share classified as wanted, and whether it reaches ``least``."""
    share = F.avg((F.col("want") == F.col("got")).cast("double"))
    return cases.agg(F.count("*").alias("cases"), F.round(share, 6).alias("share"), (share >= least).alias("calibrated"))


# Analysis.


def summary_chunks(chunks: DataFrame, *, most: int = 25, priority: int = 15) -> DataFrame:
    """First chunks of priority sections, then body chunks up to ``most``; the first ``most`` where no section has priority."""
    doc = Window.partitionBy("doc_id")
    n = F.row_number().over(Window.partitionBy("doc_id", "is_priority").orderBy("ord"))
    ranked = chunks.withColumns({"n": n, "n_priority": F.sum(F.col("is_priority").cast("int")).over(doc)})
    slots = F.lit(most) - F.least(F.lit(priority), F.col("n_priority"))
    return ranked.where(F.when(F.col("is_priority"), F.col("n") <= priority).otherwise(F.col("n") <= slots)).drop("n", "n_priority")


def review_chunks(chunks: DataFrame, most: int = 15) -> DataFrame:
    """First chunks of each document in the lexicographic order of their ids."""
    return chunks.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("paragraph_id"))).where(F.col("n") <= most)


def comparison_contexts(chunks: DataFrame, *, alone: int = 3000, total: int = 8000, spare: int = 2000, least: int = 500, most: int = 3000, fallback: int = 10) -> DataFrame:
    """Chunks of each document within its share of a session's budget, or its first ten if not even one fits."""
    papers = chunks.select("session_id", "doc_id").distinct().groupBy("session_id").agg(F.count("*").alias("papers"))
    budget = F.when(F.col("papers") == 1, alone).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.lit(total - spare) / F.col("papers")))))
    w = Window.partitionBy("doc_id").orderBy("ord")
    run = chunks.join(papers.withColumn("budget", budget), "session_id").withColumns({"running": F.sum("token_count").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "n": F.row_number().over(w)})
    fits = F.max((F.col("running") <= F.col("budget")).cast("int")).over(Window.partitionBy("doc_id"))
    return run.withColumn("fits", fits).where(F.when(F.col("fits") == 1, F.col("running") <= F.col("budget")).otherwise(F.col("n") <= fallback)).select("session_id", "doc_id", "ord", "token_count", "budget")


def best_page(spans: DataFrame, pages: DataFrame, least: float = 0.4) -> DataFrame:
    """span_id, page: the target if it holds the text, else the first page that does, else the page with most of its words (4 letters or more), else the target."""
    joined = spans.select("doc_id", "span_id", "target", F.lower("text").alias("needle")).join(pages.select("doc_id", "page", F.lower("text").alias("hay")), "doc_id")
    found = F.array_distinct(F.filter(F.split("needle", r"\s+"), lambda w: F.length(w) >= 4))
    share = F.when(F.size(found) > 0, F.size(F.filter(found, lambda w: F.contains(F.col("hay"), w))) / F.size(found)).otherwise(0.0)
    scored = joined.select("span_id", "target", "page", F.contains("hay", "needle").alias("exact"), share.alias("share"))
    place = lambda r, s, p: F.struct(F.lit(r).alias("r"), s.alias("s"), p.alias("p"))
    none = F.lit(0.0)
    rank = F.when(F.col("exact") & (F.col("page") == F.col("target")), place(3, none, -F.col("page"))).when(F.col("exact"), place(2, none, -F.col("page")))
    rank = rank.when(F.col("share") >= least, place(1, F.col("share"), -F.col("page"))).otherwise(place(0, none, F.lit(0)))
    best = scored.groupBy("span_id", "target").agg(F.max_by(F.struct("page", rank["r"].alias("r")), rank).alias("b"))
    return best.select("span_id", F.when(F.col("b.r") == 0, F.col("target")).otherwise(F.col("b.page")).alias("page"))
