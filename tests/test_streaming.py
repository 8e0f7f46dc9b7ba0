"""The keyed state machine over shuffled micro-batches and a restart, against the batch fold and a plain loop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import actions
from tidemark.streaming import tasks

NAMES = "task_key string, event_id long, kind string, at timestamp, amount decimal(18,2), until timestamp"
T = dt.datetime(2024, 3, 1)


def log(rnd, n_tasks, n_events, hours):
    """Events in time order, over `hours`; kinds are mostly legal."""
    kinds = ["generated", "open", "open", "in_progress", "snoozed", "snoozed", "done", "dismissed"]
    rows = []
    for i in range(n_events):
        at = T + dt.timedelta(seconds=rnd.randrange(hours * 3600))
        kind = rnd.choice(kinds)
        until = at + dt.timedelta(hours=rnd.randrange(-5, 200)) if kind == "snoozed" and rnd.random() < 0.7 else None
        rows.append((f"t{rnd.randrange(n_tasks)}", i, kind, at, rnd.randrange(100) if kind == "done" else None, until))
    return sorted(rows, key=lambda r: r[3])


def write(spark, rows, path):
    df = spark.createDataFrame([(*r[:4], None if r[4] is None else __import__("decimal").Decimal(r[4]), r[5]) for r in rows], NAMES)
    df.coalesce(1).write.mode("append").parquet(path)


def states_of(rows, now):
    """The fold in plain Python, by task."""
    micros = lambda t: None if t is None else int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    out = {}
    for key, i, kind, at, amount, until in sorted(rows, key=lambda r: (r[3], r[1])):
        out[key] = tasks.after(out.get(key, tasks.NEW), (micros(at), i, kind, amount, micros(until)))
    return {k: tasks.advanced(s, micros(now))[:2] + (s[3],) for k, s in out.items()}


def test_clock_cases():
    day = tasks.DAY
    s = tasks.after(tasks.NEW, (0, 1, "open", None, None))
    assert s == ("open", 0, None, 1, None, 14 * day)
    assert tasks.advanced(s, 14 * day)[0] == "open" and tasks.advanced(s, 14 * day + 1)[0] == "expired"
    z = tasks.after(s, (day, 2, "snoozed", None, 5 * day))
    assert z == ("snoozed", 0, None, 2, 5 * day, 19 * day)
    assert tasks.after(z, (4 * day, 3, "done", "5", None))[:2] == ("snoozed", 1)
    assert tasks.after(z, (5 * day, 3, "done", "5", None))[:3] == ("done", 0, "5")
    assert tasks.after(z, (20 * day, 3, "done", "5", None))[:2] == ("expired", 1)
    assert tasks.after(z, (20 * day, 3, "generated", None, None)) == ("generated", 0, None, 3, None, 34 * day)
    assert tasks.after(s, (day, 2, "snoozed", None, None))[4] == 2 * day


def test_batch_fold_equals_the_loop(spark):
    rows = log(random.Random(5), 40, 900, 24 * 60)
    now = T + dt.timedelta(days=55)
    df = spark.createDataFrame([(*r[:4], None, r[5]) for r in rows], NAMES)
    got = {r.task_key: (r.status or "", r.rejected, r.n_events) for r in actions.fold_with_clock(df, str(now)).collect()}
    assert got == states_of(rows, now) and {"expired", "snoozed", "done"} <= {s for s, _, _ in got.values()}
    assert actions.fold_with_clock(df.limit(0), str(now)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_the_batch_fold_across_a_restart(spark, tmp_path, seed):
    """Files hold slices of time whose order is shuffled within the watermark; the query stops half-way and goes on from its checkpoint."""
    rnd = random.Random(seed)
    hours, late = 24 * 40, 48
    rows = log(rnd, 25, 500, hours)
    slices = [[r for r in rows if a <= (r[3] - T).total_seconds() / 3600 < a + 60] for a in range(0, hours, 60)]
    mixed = []
    for a in slices:  # a third of each slice comes with the next one, if it is young enough by then
        held = [r for r in a if rnd.random() < 0.3 and (a[-1][3] - r[3]).total_seconds() < 24 * 3600]
        mixed.append([r for r in a if r not in held])
        mixed.append(held)
    batches = [mixed[0]] + [mixed[i] + mixed[i + 1] for i in range(1, len(mixed) - 1, 2)] + [mixed[-1]]
    top, kept = T, []
    for batch in batches:  # what the watermark of the batches before leaves
        kept += [r for r in batch if r[3] > top - dt.timedelta(hours=late)]
        top = max([top, *(r[3] for r in batch)])
        rnd.shuffle(batch)
    assert len(kept) == len(rows)

    path, states, checkpoint = str(tmp_path / "in"), str(tmp_path / "states"), str(tmp_path / "checkpoint")
    touched = []

    def run(files):
        for batch in files:
            if not batch:
                continue
            write(spark, batch, path)
            stream = spark.readStream.schema(NAMES).parquet(path)
            query = tasks.task_states(stream, f"{late} hours").writeStream.foreachBatch(tasks.write_states(states)).outputMode("update").option("checkpointLocation", checkpoint).start()
            query.processAllAvailable()
            touched.append((query.lastProgress or {}).get("numInputRows", 0) if query.lastProgress else 0)
            query.stop()

    run(batches[:4])
    run(batches[4:])
    now = top - dt.timedelta(hours=late)
    got = {r.task_key: (r.status or "", r.rejected, r.n_events) for r in tasks.latest_states(spark.read.parquet(states)).collect()}
    assert got == states_of(rows, now)
    # No batch writes more states than it has keys or timers.
    epochs = spark.read.parquet(states).groupBy("epoch").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("task_key").alias("k")).collect()
    assert all(e.n == e.k for e in epochs)
