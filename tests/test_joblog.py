"""The event log of jobs against a fold of one event after the other."""

import datetime as dt
import random

import pytest

from sitefold.operators import joblog

SCHEMA = "job_id long, at timestamp_ntz, seq int, kind string, error string"
T0 = dt.datetime(2024, 1, 1)


def fold(events):
    """(final state, outcomes of the cancels) of one job's ordered events, kept in plain variables."""
    status, asked, out, cancels = None, False, {"ignored": 0, "accepted": 0, "refused": 0}, []
    for at, seq, kind, error in events:
        if kind == "cancel":
            live = status in ("pending", "running")
            cancels.append((at, seq, status or "not found", "cancelling" if live else f"already {status}" if status else "not found"))
            out["accepted" if live else "refused"] += 1
            if live and not asked:
                asked, out["asked"] = True, at
        elif kind == "submit" and status is None:
            status, out["submitted"] = "pending", at
        elif kind == "start" and status == "pending":
            status, out["started"] = "running", at
        elif kind in ("end", "fail") and status == "running":
            status = "error" if kind == "fail" else "cancelled" if asked else "done"
            out["completed"], out["error"] = at, error if kind == "fail" else None
        else:
            out["ignored"] += 1
    seconds = (out["completed"] - out["started"]).total_seconds() if status in ("done", "cancelled") else None
    return (status or "not found", asked and status in ("pending", "running"), out.get("submitted"), out.get("started"), out.get("asked"),
            out.get("completed"), seconds, 100.0 if seconds is not None else None, out.get("error"), out["accepted"], out["refused"], out["ignored"]), cancels


def random_log(rng, n):
    """Events at few distinct times, so that ties are common."""
    kinds = rng.choices(["submit", "start", "cancel", "end", "fail"], [2, 3, rng.choice([0, 1, 4]), 1, 1], k=n)
    if rng.random() < 0.7 and n > 2:
        kinds[:2] = ["submit", "start"]
    times = sorted(rng.randrange(max(2, n)) for _ in range(n))
    return [(T0 + dt.timedelta(seconds=t / 4), i, k, f"e{i}" if k == "fail" else None) for i, (t, k) in enumerate(zip(times, kinds, strict=True))]


@pytest.mark.parametrize("bits", [10, 2])
def test_states_and_cancels_match_a_plain_fold(spark, monkeypatch, bits):
    """Also with four events to a task, so that functions are composed over several levels."""
    monkeypatch.setattr(joblog, "FAN_BITS", bits)
    rng = random.Random(bits)
    logs = {j: random_log(rng, rng.randint(1, 9)) for j in range(120)}
    logs[1000] = random_log(rng, 400)  # a third of all events
    logs[1001] = [(T0, 0, "cancel", None)]
    rows = [(j, *e) for j, log in logs.items() for e in log]
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, SCHEMA)
    states = {r["job_id"]: tuple(r)[1:] for r in joblog.job_event_states(events).collect()}
    assert states == {j: fold(log)[0] for j, log in logs.items()}
    cancels = sorted(map(tuple, joblog.cancel_outcomes(events).collect()))
    assert cancels == sorted((j, *c) for j, log in logs.items() for c in fold(log)[1])


def test_cancel_before_at_and_after_the_end(spark):
    s = [T0 + dt.timedelta(seconds=k) for k in range(10)]
    log = [(1, s[0], 0, "submit", None), (1, s[1], 1, "start", None), (1, s[3], 2, "cancel", None), (1, s[3], 3, "end", None), (1, s[4], 4, "cancel", None),
           (2, s[0], 0, "submit", None), (2, s[1], 1, "start", None), (2, s[3], 2, "end", None), (2, s[3], 3, "cancel", None),
           (3, s[0], 0, "submit", None), (3, s[0], 1, "cancel", None), (3, s[1], 2, "start", None)]
    events = spark.createDataFrame(log, SCHEMA)
    got = {r["job_id"]: r for r in joblog.job_event_states(events).collect()}
    assert (got[1]["state"], got[1]["completed_at"], got[1]["duration_seconds"], got[1]["cancels_refused"]) == ("cancelled", s[3], 2.0, 1)
    assert (got[2]["state"], got[2]["duration_seconds"], got[2]["cancels_refused"]) == ("done", 2.0, 1)
    assert (got[3]["state"], got[3]["cancelling"], got[3]["duration_seconds"]) == ("running", True, None)


def test_empty_log(spark):
    events = spark.createDataFrame([], SCHEMA)
    assert joblog.job_event_states(events).collect() == [] == joblog.cancel_outcomes(events).collect()


@pytest.mark.parametrize("broadcast", [100, 0])
def test_only_long_logs_become_functions(spark, monkeypatch, broadcast):
    """the functions of a job are eight times its state, so jobs of a few events do without them."""
    monkeypatch.setattr(joblog, "FAN_BITS", 2)
    monkeypatch.setattr(joblog, "MOST_BROADCAST", broadcast)
    seen, levels = [], joblog._levels
    monkeypatch.setattr(joblog, "_levels", lambda events: seen.append({r["job_id"] for r in events.select("job_id").collect()}) or levels(events))
    rng = random.Random(5)
    logs = {j: random_log(rng, n) for j, n in [(1, 1), (2, 4), (3, 5), (4, 30), (None, 6)]}
    events = spark.createDataFrame([(j, *e) for j, log in logs.items() for e in log], SCHEMA)
    states = {r["job_id"]: tuple(r)[1:] for r in joblog.job_event_states(events).collect()}
    assert states == {j: fold(log)[0] for j, log in logs.items()}
    assert seen == [{3, 4, None}]
    short = events.where("job_id < 3")
    assert {r["job_id"] for r in joblog.job_event_states(short).collect()} == {1, 2} and len(seen) == 1


def test_cancels_of_short_logs_need_no_functions(spark, monkeypatch):
    """what a cancel met is read off the lists of short logs; only long ones are walked down by level."""
    monkeypatch.setattr(joblog, "FAN_BITS", 2)
    seen, levels = [], joblog._levels
    monkeypatch.setattr(joblog, "_levels", lambda events: seen.append({r["job_id"] for r in events.select("job_id").collect()}) or levels(events))
    rng = random.Random(6)
    logs = {j: random_log(rng, n) for j, n in [(1, 3), (2, 4), (3, 5), (4, 60)]}
    logs[5] = [(T0, i, "cancel", None) for i in range(4)]
    events = spark.createDataFrame([(j, *e) for j, log in logs.items() for e in log], SCHEMA)
    want = sorted((j, *c) for j, log in logs.items() for c in fold(log)[1])
    assert sorted(map(tuple, joblog.cancel_outcomes(events).collect())) == want and seen == [{3, 4}]


def test_cancels_of_short_logs_are_read_off_sorted_rows(spark):
    """no list of a job's events, and no error texts, are built for its cancels; ties go by kind."""
    rng = random.Random(7)
    kinds = ["submit", "start", "cancel", "end", "fail", "other", None]
    logs = {j: [(T0 + dt.timedelta(seconds=rng.randrange(3)), rng.randrange(2), rng.choice(kinds), None) for _ in range(rng.randint(1, 12))] for j in range(150)}
    events = spark.createDataFrame([(j, *e) for j, log in logs.items() for e in log], SCHEMA)
    out = joblog.cancel_outcomes(events)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "error#" not in plan
    want = sorted((j, *c) for j, log in logs.items() for c in fold(sorted(log, key=lambda e: (e[0], e[1], e[2] or "")))[1])
    assert sorted(map(tuple, out.collect())) == want
