"""The event log of jobs (J10, J11, C11): states folded from submit, start, cancel, end and fail events.

A log of up to 1,024 events is one list and folded from its start; what its cancels met is read off
its sorted rows, which are first written as a narrow table, as both the counts and the rows read it.  Longer logs are told by their
counts and folded in pieces: an event is a function from states to states, so a stretch of events is
one too, and composing functions is associative.  Their events are numbered in the order (job, time,
seq); every 1,024 neighbouring events of a job become one function, every 1,024 of those one more,
until a job has a single one.  No list holds more than 1,024 events or functions, however long a job's
log is, and only long logs pay for functions, which are eight times a state.  The same levels, walked
back down, give the state in which each event found its job.

Rules: a job is pending from its submission and running from its start.  A cancel request is accepted
while the job is pending or running; the job then ends as cancelled, at its end event.  A
failure ends it as an error, cancel or not, and then without duration.  Nothing changes a finished
job, and a job that was never submitted is not found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitefold.functions.plan import materialize, range_numbered
from sitefold.operators.jobs import seconds_between
from sitefold.sources.sinks import scratch_path

# --- fixed values -----------------------------------------------------------------------------
UNKNOWN, PENDING, PENDING_CANCEL, RUNNING, RUNNING_CANCEL, DONE, ERROR, CANCELLED = range(8)
#: State names as clients see them; a request to cancel shows in ``cancelling``.
NAMES = ("not found", "pending", "pending", "running", "running", "done", "error", "cancelled")
STEPS = {
    "submit": {UNKNOWN: PENDING},
    "start": {PENDING: RUNNING, PENDING_CANCEL: RUNNING_CANCEL},
    "cancel": {PENDING: PENDING_CANCEL, PENDING_CANCEL: PENDING_CANCEL, RUNNING: RUNNING_CANCEL, RUNNING_CANCEL: RUNNING_CANCEL},
    "end": {RUNNING: DONE, RUNNING_CANCEL: CANCELLED},
    "fail": {RUNNING: ERROR, RUNNING_CANCEL: ERROR},
}
# ----------------------------------------------------------------------------------------------

#: Events or functions composed by one task at a time, as a power of two.
FAN_BITS = 10
#: Ids of long logs that are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 100_000

#: What a function says for one state it may start from: where it leads, and what it notes on the way.
_ENTRY = ("struct<to:int,submitted_at:timestamp_ntz,started_at:timestamp_ntz,cancel_requested_at:timestamp_ntz,"
          "completed_at:timestamp_ntz,error:string,accepted:bigint,refused:bigint,ignored:bigint>")
_FIRST = ("submitted_at", "started_at", "cancel_requested_at", "completed_at", "error")
_COUNTS = ("accepted", "refused", "ignored")


def _next(state: Column, kind: Column) -> Column:
    """The state after an event of ``kind``; null when it has no effect."""
    moves = F.array(*[F.array(*[F.lit(STEPS[k].get(s)).cast("int") for s in range(len(NAMES))]) for k in STEPS])
    which = F.array_position(F.array(*[F.lit(k) for k in STEPS]), kind)
    return F.get(F.get(moves, (which - 1).cast("int")), state)


def _entry(**fields: Column) -> Column:
    return F.struct(*[fields[n].alias(n) for n in ("to", *_FIRST, *_COUNTS)]).cast(_ENTRY)


def _unmoved(state: int) -> Column:
    return _entry(to=F.lit(state), **{n: F.lit(None) for n in _FIRST}, **{n: F.lit(0) for n in _COUNTS})


def _identity() -> Column:
    return F.array(*[_unmoved(s) for s in range(len(NAMES))])


def _after_event(x: Column, event: Column) -> Column:
    """The entry ``x`` continued by one event (kind, at, error)."""
    kind, to = event["kind"], _next(x["to"], event["kind"])
    took = to.isNotNull()
    cancel = kind == "cancel"

    def first(name: str, when: Column, value: Column) -> Column:
        return F.coalesce(x[name], F.when(took & when, value))

    return _entry(
        to=F.coalesce(to, x["to"]),
        submitted_at=first("submitted_at", kind == "submit", event["at"]), started_at=first("started_at", kind == "start", event["at"]),
        cancel_requested_at=first("cancel_requested_at", cancel, event["at"]),
        completed_at=first("completed_at", kind.isin("end", "fail"), event["at"]), error=first("error", kind == "fail", event["error"]),
        accepted=x["accepted"] + F.when(cancel & took, 1).otherwise(0), refused=x["refused"] + F.when(cancel & ~took, 1).otherwise(0),
        ignored=x["ignored"] + F.when(~cancel & ~took, 1).otherwise(0))


def _after_function(x: Column, f: Column) -> Column:
    """The entry ``x`` continued by a function."""
    y = F.get(f, x["to"])
    return _entry(to=y["to"], **{n: F.coalesce(x[n], y[n]) for n in _FIRST}, **{n: x[n] + y[n] for n in _COUNTS})


def _split(log: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The events of jobs with at most ``2 ** FAN_BITS`` of them, and those of the other jobs, if there are any."""
    counts = log.groupBy(F.col("job_id").alias("_long")).agg(F.count(F.lit(1)).alias("n"))
    many = materialize(counts.where(F.col("n") > 1 << FAN_BITS).select("_long"))
    n = many.count()
    if not n:
        return log, None
    many = F.broadcast(many) if n <= MOST_BROADCAST else many
    same = F.col("job_id").eqNullSafe(F.col("_long"))
    return log.join(many, same, "left_anti"), log.join(many, same, "left_semi")


def _levels(events: DataFrame) -> list[DataFrame]:
    """(job_id, at, list) by level, lists in order: of events at the bottom, of functions with their
    place above.  ``f`` is the list composed; in the last level a job has one row."""
    log = range_numbered(events.select("job_id", "at", "seq", "kind", "error"), ["job_id", "at", "seq"], "place")
    item = F.struct("place", "kind", "at", "seq", "error")
    rows = log.groupBy("job_id", F.shiftright("place", FAN_BITS).alias("chunk")).agg(F.sort_array(F.collect_list(item)).alias("list"))
    f = F.aggregate("list", _identity(), lambda acc, e: F.transform(acc, lambda x: _after_event(x, e)))
    out = [materialize(rows.withColumn("f", f))]
    while not out[-1].where("chunk > 0").isEmpty():
        item = F.struct(F.col("chunk").alias("place"), "f")
        rows = out[-1].groupBy("job_id", F.shiftright("chunk", FAN_BITS).alias("chunk")).agg(F.sort_array(F.collect_list(item)).alias("list"))
        f = F.aggregate("list", _identity(), lambda acc, e: F.transform(acc, lambda x: _after_function(x, e["f"])))
        out.append(materialize(rows.withColumn("f", f)))
    return out


def job_event_states(events: DataFrame) -> DataFrame:
    """One row per job of the log ``events`` (job_id, at, seq, kind, error): its state, times,
    duration and progress, and how many cancel requests were accepted and refused and how many other
    events came too late or twice.  (at, seq) orders a job's events."""
    short, rest = _split(materialize(events.select("job_id", "at", "seq", "kind", "error")))
    lists = short.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("at", "seq", "kind", "error"))).alias("list"))
    end = lists.select("job_id", F.aggregate("list", _unmoved(UNKNOWN), _after_event).alias("e"))
    if rest is not None:
        end = end.unionByName(_levels(rest)[-1].select("job_id", F.get("f", F.lit(UNKNOWN)).alias("e")))
    end = end.select("job_id", "e.*")
    state = F.get(F.array(*[F.lit(n) for n in NAMES]), F.col("to"))
    finished = F.col("to").isin(DONE, CANCELLED)
    return end.select(
        "job_id", state.alias("state"), F.col("to").isin(PENDING_CANCEL, RUNNING_CANCEL).alias("cancelling"),
        "submitted_at", "started_at", "cancel_requested_at", "completed_at",
        F.when(finished, seconds_between(F.col("completed_at"), F.col("started_at"))).alias("duration_seconds"),
        F.when(finished, F.lit(100.0)).alias("progress_pct"), "error",
        F.col("accepted").alias("cancels_accepted"), F.col("refused").alias("cancels_refused"), F.col("ignored").alias("events_ignored"))


def _cancels_met(events: DataFrame) -> DataFrame:
    """(job_id, at, seq, state): the cancel requests of whole logs with the state that each meets, from the
    places of the first submission, the first start after it and the first end after that.  The rows of
    a job are sorted once; events at one (at, seq) come in the order of their kinds, as in a sorted list."""
    kinds = sorted(STEPS)
    rank = {k: i + 1 for i, k in enumerate(kinds)}
    k = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in kinds]), F.col("kind")), F.lit(0))
    df = events.select("job_id", "at", "seq", k.cast("int").alias("k"))
    order = Window.partitionBy("job_id").orderBy("at", "seq", "k")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    k = F.col("k")
    df = df.withColumns({"place": F.row_number().over(order), "submitted": F.max(k == rank["submit"]).over(upto)})
    df = df.withColumns({"started": F.max(F.col("submitted") & (k == rank["start"])).over(upto),
                         "asked": F.min(F.when(F.col("submitted") & (k == rank["cancel"]), F.col("place"))).over(upto)})
    ends = F.col("started") & k.isin(rank["end"], rank["fail"])
    # the place of the end and its kind in one number
    df = df.withColumn("ended", F.min(F.when(ends, F.col("place").cast("long") * 8 + k)).over(upto)).where(k == rank["cancel"])
    state = (F.when(~F.col("submitted"), UNKNOWN).when(F.col("ended").isNull(), F.when(F.col("started"), RUNNING).otherwise(PENDING))
             .when(F.col("ended") % 8 == rank["fail"], ERROR).when(F.col("asked").cast("long") * 8 < F.col("ended"), CANCELLED).otherwise(DONE))
    return df.select("job_id", "at", "seq", state.alias("state"))


def cancel_outcomes(events: DataFrame) -> DataFrame:
    """One row per cancel request of the log: job_id, at, seq, the state it met and its outcome --
    'cancelling', 'already <state>' for a finished job, 'not found' for an unknown one."""
    def walked(lists: DataFrame, step, noted) -> DataFrame:
        """The ``noted`` items of the lists with the state that each meets."""
        none = F.lit([]).cast("array<struct<item:int,state:int>>")
        n = F.transform("list", lambda e, i: F.struct(i.alias("i"), e.alias("e")))
        path = F.aggregate(n, F.struct(F.col("state").alias("now"), none.alias("met")), lambda acc, x: F.struct(
            step(acc["now"], x["e"]).alias("now"),
            F.when(noted(x["e"]), F.concat(acc["met"], F.array(F.struct(x["i"].alias("item"), acc["now"].alias("state")))))
            .otherwise(acc["met"]).alias("met")))
        return lists.withColumn("m", F.explode(path["met"])).select("job_id", F.get("list", F.col("m.item")).alias("e"), F.col("m.state").alias("state"))

    path = scratch_path(events.sparkSession, "job-log")
    log = events.where(F.col("job_id").isNotNull()).select("job_id", "at", "seq", "kind")
    log.write.parquet(path)
    short, rest = _split(events.sparkSession.read.schema(log.schema).parquet(path))
    items = _cancels_met(short)
    if rest is not None:
        levels = _levels(rest.withColumn("error", F.lit(None).cast("string")))
        met = levels[-1].select("job_id", "chunk", F.lit(UNKNOWN).alias("state"))
        for level in reversed(levels[1:]):
            below = walked(level.join(met, ["job_id", "chunk"]), lambda now, e: F.get(e["f"], now)["to"], lambda e: F.lit(True))
            met = materialize(below.select("job_id", F.col("e.place").alias("chunk"), "state"))
        found = walked(levels[0].join(met, ["job_id", "chunk"]), lambda now, e: F.coalesce(_next(now, e["kind"]), now), lambda e: e["kind"] == "cancel")
        items = items.unionByName(found.select("job_id", "e.at", "e.seq", "state"))
    name = F.get(F.array(*[F.lit(n) for n in NAMES]), F.col("state"))
    outcome = (F.when(F.col("state") == UNKNOWN, F.lit("not found"))
               .when(F.col("state").isin(DONE, ERROR, CANCELLED), F.concat(F.lit("already "), name)).otherwise(F.lit("cancelling")))
    return items.select("job_id", "at", "seq", name.alias("state_met"), outcome.alias("outcome"))
