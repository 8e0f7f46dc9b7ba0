"""The task table: nightly sweep and refresh, with nulls, set flags and finished tasks."""

import datetime as dt

from tidemark.operators import actions

NOW = "2024-01-20 00:00:00"
T = dt.datetime(2024, 1, 20)
NAMES = (
    "task_key string, status string, urgency string, priority double, due_date timestamp, snooze_until timestamp, expires_at timestamp, "
    f"sla_breached boolean, escalated_to int, updated_at timestamp, generated_at timestamp, notes string, status_history {actions.HISTORY}"
)


def task(key, status="open", urgency="high", due=None, snooze=None, expires=None, late=False, to=None):
    day = lambda n: None if n is None else T + dt.timedelta(days=n)
    return (key, status, urgency, 1.0, day(due), day(snooze), day(expires), late, to, day(-9), day(-10), "mine", [])


def test_sweep_loses_no_task_without_dates(spark):
    rows = [
        task("no dates"),
        task("null status", status=None, due=-1, expires=-1),
        task("null flag", due=-1, late=None),
        task("late", due=-1, expires=1),
        task("late, normal", urgency="normal", due=-1),
        task("late, no urgency", urgency=None, due=-1),
        task("flagged before", due=1, late=True),
        task("sent before", due=-1, late=True, to=5),
        task("sleeping", status="snoozed", due=-1, snooze=1),
        task("sleeping flagged", status="snoozed", due=-1, snooze=1, late=True),
        task("woken", status="snoozed", due=1, snooze=0),
        task("woken late", status="snoozed", due=-1, snooze=-1),
        task("endless sleep", status="snoozed", due=-1),
        task("expired", expires=-1),
        task("expires now", expires=0),
        task("done", status="done", due=-1, expires=-1),
    ]
    got = {r.task_key: r for r in actions.sweep(spark.createDataFrame(rows, NAMES), NOW, 7).collect()}
    assert set(got) == {r[0] for r in rows} - {"expired"}
    assert {k for k, r in got.items() if r.sla_breached} == {"null flag", "late", "late, normal", "late, no urgency", "flagged before", "sent before", "sleeping flagged", "woken late", "endless sleep"}
    assert {k: r.escalated_to for k, r in got.items() if r.escalated_to} == {"null flag": 7, "late": 7, "flagged before": 7, "sent before": 5, "woken late": 7, "endless sleep": 7}
    assert {k for k, r in got.items() if r.updated_at == T} == {"null flag", "late", "late, normal", "late, no urgency", "flagged before", "woken", "woken late", "endless sleep"}
    assert {k: [(h["from"], h["to"], h["at"]) for h in r.status_history] for k, r in got.items() if r.status_history} == {k: [("snoozed", "open", T)] for k in ("woken", "woken late")}
    again = {r.task_key: r.escalated_to for r in actions.sweep(spark.createDataFrame(rows, NAMES), NOW).collect()}
    assert {k: v for k, v in again.items() if v} == {"sent before": 5}
    twice = actions.sweep(actions.sweep(spark.createDataFrame(rows, NAMES), NOW, 7), NOW, 8)
    assert sorted(map(str, twice.collect())) == sorted(map(str, got.values()))
    assert actions.sweep(spark.createDataFrame([], NAMES), NOW, 7).count() == 0


def test_upsert_refreshes_computed_columns_only(spark):
    old = spark.createDataFrame([task("a", status="done", late=True), task("b", status="snoozed", snooze=2, late=True, to=5, expires=1), task("c", expires=1), task(None), task("n", status=None)], NAMES)
    new = spark.createDataFrame([(k, 9.0, "low", T) for k in ("a", "b", "d", "n", None)], "task_key string, priority double, urgency string, due_date timestamp")
    rows = actions.upsert(old, new, NOW).collect()
    got = {r.task_key: r for r in rows if r.task_key}
    assert len(rows) == 7 and set(got) == set("abcdn")
    assert (got["a"].priority, got["a"].urgency, got["a"].updated_at) == (1.0, "high", T - dt.timedelta(days=9))
    b = got["b"]
    assert (b.priority, b.urgency, b.due_date, b.updated_at, b.expires_at) == (9.0, "low", T, T, T + dt.timedelta(days=14))
    assert (b.status, b.snooze_until, b.sla_breached, b.escalated_to, b.notes, b.generated_at) == ("snoozed", T + dt.timedelta(days=2), True, 5, "mine", T - dt.timedelta(days=10))
    assert (got["c"].priority, got["c"].expires_at) == (1.0, T + dt.timedelta(days=1))
    d = got["d"]
    assert (d.status, d.sla_breached, d.escalated_to, d.notes, d.generated_at, d.expires_at) == ("open", False, None, None, T, T + dt.timedelta(days=14))
    assert [(h["from"], h["to"], h["by"]) for h in d.status_history] == [("generated", "open", "system")]
    assert got["n"].priority == 9.0 and got["n"].status is None
