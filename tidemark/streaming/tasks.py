"""The task log as a keyed state machine with timers: a state store instead of the log.

A batch reads and writes the state of its own keys alone. Events of one task may come in any order within the watermark: the
state is the fold of what is older than the watermark, and the younger events beside it. Timers wake snoozed tasks and
drop expired ones without an event.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.actions import ACTIVE, NEXT, SNOOZE_DAYS, TTL_DAYS

DAY = 86_400_000_000
OUT = "task_key string, status string, rejected int, amount string, n_events int, snooze_us long, expires_us long"
STATE = "status string, rejected int, amount string, n_events int, snooze_us long, expires_us long, pending string"
#: An unseen task: status, rejected, amount, n_events, snooze and expiry in microseconds.
NEW = ("", 0, None, 0, None, None)


def advanced(s: tuple, now: int) -> tuple:
    """The state when the clock reaches now: a snooze that is over opens the task, an active one past its expiry is expired."""
    status, rejected, amount, n, snooze, expires = s
    if status == "snoozed" and snooze <= now:
        status, snooze = "open", None
    if status in ACTIVE and expires < now:
        status, snooze = "expired", None
    return status, rejected, amount, n, snooze, expires


def after(s: tuple, event: tuple) -> tuple:
    """The state after an event (at, event_id, kind, amount, until); one that is no allowed next state is counted and ignored."""
    at, _, kind, paid, until = event
    status, rejected, amount, n, snooze, expires = advanced(s, at)
    allowed = ("generated", "open") if status in ("", "expired") else NEXT[status]
    if kind not in allowed:
        return status, rejected + 1, amount, n + 1, snooze, expires
    if kind == "snoozed":
        snooze = at + SNOOZE_DAYS * DAY if until is None else until
        expires = max(snooze, at) + TTL_DAYS * DAY
    else:
        expires = at + TTL_DAYS * DAY if status in ("", "expired") else expires
        snooze = None
    return kind, rejected, paid if kind == "done" else amount, n + 1, snooze, expires


def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One key of one batch, or its timer."""
    *kept, held = state.get if state.exists else (*NEW, "[]")
    s, pending = tuple(kept), [tuple(e) for e in json.loads(held)]
    watermark = state.getCurrentWatermarkMs() * 1000
    for frame in frames if not state.hasTimedOut else ():
        clean = frame.astype(object).where(frame.notna(), None)
        pending += [(int(at), int(i), kind, amount, None if until is None else int(until)) for at, i, kind, amount, until in zip(clean["at_us"], clean["event_id"], clean["kind"], clean["amount"], clean["until_us"])]
    pending.sort(key=lambda e: e[:2])
    while pending and pending[0][0] <= watermark:
        s = after(s, pending.pop(0))
    s = advanced(s, watermark) if not pending or watermark < pending[0][0] else s
    state.update((*s, json.dumps(pending)))
    waits = [e[0] for e in pending[:1]] + ([s[4] - 1000] if s[0] == "snoozed" else [s[5]] if s[0] in ACTIVE else [])
    if waits:
        state.setTimeoutTimestamp(max(min(waits), watermark) // 1000 + 1)
    for event in pending:
        s = after(s, event)
    yield pd.DataFrame([(key[0], *s)], columns=["task_key", "status", "rejected", "amount", "n_events", "snooze_us", "expires_us"]).astype({"snooze_us": "Int64", "expires_us": "Int64"})


def task_states(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Changed task states of a stream of events (task_key, event_id, kind, at, amount, until), in update mode.

    A row per key that a batch touches or whose timer ran out: status, rejected, amount, n_events, snooze_until, expires_at. Events
    later than `late` behind the newest are dropped.
    """
    rows = events.withWatermark("at", late).select("task_key", "event_id", "kind", "at", F.unix_micros("at").alias("at_us"), F.col("amount").cast("string").alias("amount"), F.unix_micros("until").alias("until_us"))
    states = rows.groupBy("task_key").applyInPandasWithState(fold, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return states.select("task_key", F.nullif("status", F.lit("")).alias("status"), "rejected", F.col("amount").cast("decimal(18,2)").alias("amount"), "n_events", F.timestamp_micros("snooze_us").alias("snooze_until"), F.timestamp_micros("expires_us").alias("expires_at"))


def write_states(path: str):
    """A foreachBatch function: the batch's changed states under a version folder of its own, so that a repeated batch is the same."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return run


def latest_states(states: DataFrame) -> DataFrame:
    """The newest state of each task over all epochs."""
    names = [c for c in states.columns if c not in ("task_key", "epoch")]
    return states.groupBy("task_key").agg(F.max_by(F.struct(*names), "epoch").alias("s")).select("task_key", "s.*")
