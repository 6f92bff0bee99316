"""Stream operators that work in the order of events: any split into micro-batches equals the batch operators."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from docspark.operators import library
from docspark.streaming import ordered

T0 = dt.datetime(2024, 1, 1)


def micro_batches(spark, folder, rows, schema, cuts):
    """A stream of the rows in their order, one file a micro-batch."""
    os.makedirs(folder)
    edges = [0, *sorted(cuts), len(rows)]
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if a < b:
            frame = spark.createDataFrame(rows[a:b], schema).toPandas()
            frame["ts"] = frame["ts"].astype("datetime64[us]")
            frame.to_parquet(f"{folder}/{k:04}.parquet", index=False)
            os.utime(f"{folder}/{k:04}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drained(spark, df, folder, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.table(name)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def jittered(rng, rows, at, most):
    """Out of order, but by less than ``most`` seconds."""
    return sorted(rows, key=lambda r: (r[at] - T0).total_seconds() + rng.random() * most)


@pytest.mark.parametrize(("seed", "batches"), [(0, 1), (1, 5), (2, 9)])
def test_admission_equals_the_batch_form(spark, rocks, tmp_path, seed, batches):
    rng = random.Random(seed)
    rows, t = [], 0.0
    for k in range(260):
        t += rng.choice([0, 0, 0.001, 1, 7, 15, 59.999, 60, 200])
        rows.append((rng.choice([1, 1, 1, 2, 3]), k, T0 + dt.timedelta(seconds=round(t, 3))))
    schema = "client long, event_id long, ts timestamp"
    want = sorted(map(tuple, library.admit(spark.createDataFrame(rows, schema), 3, 60.0).collect()))
    last = (99, 9999, T0 + dt.timedelta(days=9))
    mixed = [*jittered(rng, rows, 2, 100), last, (99, 10_000, last[2] + dt.timedelta(days=9))]
    stream = micro_batches(spark, f"{tmp_path}/in", mixed, schema, [*rng.sample(range(1, 260), batches - 1), 260, 261])
    got = drained(spark, ordered.admitted(stream, 3, 60.0, late="2 minutes"), tmp_path, f"admitted{seed}")
    assert sorted(map(tuple, got.where("client <> 99").collect())) == want


def progress(seed):
    rng = random.Random(seed)
    batches = [(b, b * 10 + p, T0 + dt.timedelta(seconds=300 * b)) for b in range(12) for p in range(1 + b % 4)]
    rows, k = [], 0
    for b, paper, started in batches:
        for _ in range(rng.choice([0, 1, 1, 2, 4]) if b % 5 == 4 else rng.choice([1, 2, 4])):
            rows.append((b, paper, k, started + dt.timedelta(seconds=rng.choice([0, 1, 30, 30, 200, 659.5, 660, 661, 900])), rng.choice(["queued", "FAILED", "Completed", "completed", None, "Embedding"])))
            k += 1
        if rng.random() < 0.7:
            rows.append((b, paper, k, started + dt.timedelta(seconds=300), "COMPLETED"))
            k += 1
    rows.append((3, 999, k, T0, "COMPLETED"))  # no paper of the batch
    return rows, batches


def brute_completions(rows, batches):
    out = {}
    for b in {b for b, _, _ in batches}:
        papers = {p for x, p, _ in batches if x == b}
        end = min(s for x, _, s in batches if x == b) + dt.timedelta(seconds=660)
        state = dict.fromkeys(papers, "pending")
        out[b] = (end, len(papers), 0, 0, False)
        for x, p, _, ts, status in sorted((r for r in rows if r[0] == b and r[1] in papers and r[3] <= end), key=lambda r: (r[3], r[2])):
            state[p] = status and status.lower()
            if all(s in (None, "completed", "failed") for s in state.values()):
                n = sum(s == "completed" for s in state.values())
                out[b] = (ts, len(papers), n, len(papers) - n, True)
                break
    return sorted((b, round((r[0] - T0).total_seconds() * 1e6), *r[1:]) for b, r in out.items())


PROGRESS, BATCHES = "batch_id long, paper_id long, event_id long, ts timestamp, status string", "batch_id long, paper_id long, started timestamp"


def shifted(df):
    zero = round((T0 - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
    return sorted((r["batch_id"], r["at"] - zero, r["total"], r["completed"], r["failed"], r["done"]) for r in df.collect())


@pytest.mark.parametrize("seed", range(4))
def test_completions_equal_a_replay(spark, seed):
    rows, batches = progress(seed)
    random.Random(seed).shuffle(rows)
    got = library.batch_completions(spark.createDataFrame(rows, PROGRESS).repartition(3), spark.createDataFrame(batches, BATCHES))
    assert shifted(got) == brute_completions(rows, batches)


@pytest.mark.parametrize(("seed", "cuts"), [(0, 0), (1, 6)])
def test_streamed_completions_equal_the_batch_form(spark, rocks, tmp_path, seed, cuts):
    rows, batches = progress(seed)
    rng = random.Random(seed)
    with_events = {b for b, p, *_ in rows if (b, p) in {(x, y) for x, y, _ in batches}}
    want = [r for r in brute_completions(rows, batches) if r[0] in with_events]
    batches.append((99, 1, T0))
    ends = [(99, 1, 10_000 + k, T0 + dt.timedelta(days=9 * (k + 1)), "x") for k in range(2)]
    mixed = [*jittered(rng, rows, 3, 50), *ends]
    n = len(rows)
    stream = micro_batches(spark, f"{tmp_path}/in", mixed, PROGRESS, [*rng.sample(range(1, n), cuts), n, n + 1])
    got = drained(spark, ordered.batch_completions(stream, spark.createDataFrame(batches, BATCHES), late="1 minute"), tmp_path, f"complete{seed}")
    assert shifted(got.where(F.col("batch_id") != 99)) == want
