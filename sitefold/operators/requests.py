"""Crawl requests: validation (J1) and TTL deduplication.

TTL dedup is sequential per key: a request starts a new job when it arrives at or after the expiry
of the key's latest *kept* request (expiry = completion + ttl for a job that succeeds, completion
for one that fails; a running job is always reused).  It is computed without folding a key's
requests in one task, so one url holding a third of all requests still spreads over the cluster:

1. ``next(r)``: the first request of the key at or after ``expiry(r)`` -- an as-of successor join,
   done with a streaming window inside (key, time chunk) plus a carry through the much smaller
   per-chunk summary for targets in later chunks;
2. blocks: requests in the order (key, time, id), cut into blocks of at most 4,096 neighbours; inside a
   block the pointers are followed to the request that leaves it, so a block is crossed in one step;
3. pointer doubling only over the requests at which a chain may enter a block (J_0 = the step to the
   next block, J_k = J_{k-1} o J_{k-1}), expanded from the key's first request with the J_k from the
   largest jump down (rounds: log of the blocks of a key, not of its jobs);
4. the blocks are walked from where the kept chains enter them;
5. every request maps to the latest kept request at or before it (as-of predecessor, chunked the
   same way).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitefold.functions import urls as U
from sitefold.functions.plan import materialize

# --- fixed values -----------------------------------------------------------------------------
TTL_SECONDS = 3600
MAX_PAGES_RANGE = (1, 200)
MAX_DEPTH_RANGE = (1, 10)
CHUNK_SECONDS = 86400  # time chunk of the as-of windows (a hot key spreads over its chunks)
BLOCK_ROWS = 4096  # most requests whose pointers one step follows
# ----------------------------------------------------------------------------------------------


def validate_requests(requests: DataFrame, cap_batch: bool = False) -> DataFrame:
    """``reject_reason`` (null when valid) and ``accepted_url`` (a bare host gets '/').

    Valid: http(s) url with a host, max_pages in 1..200, max_depth in 1..10.  ``cap_batch``
    applies the batch form: same bounds, then max_pages capped at 200.
    """
    df = U.add_url_parts(requests, "url", "v")
    ok_url = F.col("v_scheme").isin("http", "https") & (F.regexp_replace(F.col("v_netloc"), "^.*@|:[0-9]*$", "") != "")
    lo_p, hi_p = MAX_PAGES_RANGE
    lo_d, hi_d = MAX_DEPTH_RANGE
    mp = F.col("max_pages")
    if cap_batch:
        mp = F.least(mp, F.lit(hi_p))
    reason = (F.when(~ok_url, F.lit("invalid url"))
              .when((mp < lo_p) | (mp > hi_p), F.lit("max_pages out of range"))
              .when((F.col("max_depth") < lo_d) | (F.col("max_depth") > hi_d), F.lit("max_depth out of range")))
    accepted = F.when(reason.isNull(), F.when((F.col("v_path") == "") & (F.col("v_params") == ""),
                                              F.concat(F.regexp_replace(F.col("url"), "[?#].*$", ""), F.lit("/"),
                                                       F.regexp_extract(F.col("url"), "([?#].*)$", 1)))
                      .otherwise(F.col("url")))
    df = df.withColumns({"reject_reason": reason, "accepted_url": accepted, "max_pages": mp})
    return U.drop_url_parts(df, "v")


def _micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def asof_successor(data: DataFrame, probes: DataFrame, chunk: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """For each probe (key, t, s, pid, ``keep`` of long): the first data row (key, t, s, did) with (t, s)
    strictly greater than the probe's (t, s).  Columns: key, pid, did (null when none), ``keep``."""
    none = F.lit(None).cast("long")
    d = data.select("key", "t", "s", F.col("did"), none.alias("pid"), F.lit(0).alias("typ"), *[none.alias(c) for c in keep])
    p = probes.select("key", "t", "s", none.alias("did"), "pid", F.lit(1).alias("typ"), *keep)
    both = d.unionByName(p).withColumn("chunk", F.floor(F.col("t") / (chunk * 1_000_000)))
    # inside (key, chunk): reverse running 'last non-null data id' = nearest data row after the probe
    w = Window.partitionBy("key", "chunk").orderBy(F.col("t").desc(), F.col("s").desc(), F.col("typ").desc()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("nd", F.last("did", ignorenulls=True).over(w))
    found = both.filter(F.col("typ") == 1).select("key", "chunk", "pid", "nd", *keep)
    # carry: first data row of the nearest later chunk that has data (summary: one row per chunk)
    firsts = d.withColumn("chunk", F.floor(F.col("t") / (chunk * 1_000_000))).groupBy("key", "chunk") \
        .agg(F.min_by("did", F.struct("t", "s")).alias("first_did"))
    summary = firsts.unionByName(found.select("key", "chunk", F.lit(None).cast("long").alias("first_did"))) \
        .groupBy("key", "chunk").agg(F.max("first_did").alias("first_did"))
    ws = Window.partitionBy("key").orderBy(F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("later", F.last("first_did", ignorenulls=True).over(ws))
    out = found.join(summary.select("key", "chunk", "later"), ["key", "chunk"], "left")
    return out.select("key", "pid", F.coalesce(F.col("nd"), F.col("later")).alias("did"), *keep)


def asof_predecessor(rows: DataFrame, chunk: int, keep: tuple[str, ...] = ("rid",)) -> DataFrame:
    """For each row (key, t, s, rid, mark): the rid of the latest marked row at or before it
    (in (t, s) order).  Columns: ``keep``, prev."""
    df = rows.withColumn("chunk", F.floor(F.col("t") / (chunk * 1_000_000)))
    # keys may begin alike for many characters; a number first makes their sort cheap
    df = df.withColumn("_group", F.xxhash64("key", "chunk"))
    w = Window.partitionBy("_group", "key", "chunk").orderBy("t", "s")
    df = df.withColumns({"p": F.last(F.when(F.col("mark"), F.col("rid")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
                         "more": F.lead(F.lit(True)).over(w)})
    lasts = df.where(F.col("more").isNull()).select("key", "chunk", F.col("p").alias("last_mark"))
    ws = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.withColumn("earlier", F.last("last_mark", ignorenulls=True).over(ws))
    out = df.join(lasts.select("key", "chunk", "earlier"), ["key", "chunk"], "left")
    return out.select(*keep, F.coalesce(F.col("p"), F.col("earlier")).alias("prev"))


def _block_batch(block: int, rid: np.ndarray, nxt: np.ndarray) -> pa.RecordBatch:
    """One block as a row: its ids, for each the place in the block that its pointer leads to (-1:
    none, or not a single one further on), and the id reached by the pointer that leaves the block."""
    n, order = len(rid), np.argsort(rid, kind="stable")
    left, right = (np.searchsorted(rid[order], nxt, side) for side in ("left", "right"))
    place = order[np.minimum(left, n - 1)]
    at = np.where((right - left == 1) & (place > np.arange(n)), place, -1)
    last = np.where(at >= 0, at, np.arange(n))
    while not np.array_equal(further := last[last], last):
        last = further
    bounds = pa.array([0, n], pa.int32())
    lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (rid, at.astype("int32"), nxt[last])]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *lists], names=["block", "rids", "places", "exits"])


def _cut_blocks(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            rid, nxt = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "nxt"))
            for i in range(0, len(rid), size):
                yield _block_batch(block, rid[i:i + size], nxt[i:i + size])
                block += 1

    return run


def _walk_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids met inside the blocks (rids, places) from the ids ``entered`` on."""
    for batch in batches:
        for rids, places, entered in zip(*(batch.column(c) for c in ("rids", "places", "entered")), strict=True):
            rid, to = rids.values.to_numpy(), places.values.tolist()
            met: set[int] = set()
            for i in np.flatnonzero(np.isin(rid, entered.values.to_numpy())).tolist():
                while (i := to[i]) >= 0 and i not in met:
                    met.add(i)
            yield pa.RecordBatch.from_arrays([pa.array(rid[sorted(met)], pa.int64())], names=["rid"])


def reached(heads: DataFrame, jump: DataFrame, order: list[str]) -> DataFrame:
    """(rid): ``heads`` (rid) and all that the pointers ``jump`` (rid, nxt, columns of ``order``) lead to
    from them, each once, materialized.  Pointers lead forward in ``order`` (steps 2 to 4)."""
    laid = jump.where("rid IS NOT NULL AND nxt IS NOT NULL").repartitionByRange(*order).sortWithinPartitions(*order).select("rid", "nxt")
    blocks = materialize(laid.mapInArrow(_cut_blocks(BLOCK_ROWS), "block long, rids array<long>, places array<int>, exits array<long>"))
    exits = blocks.select(F.explode(F.array_distinct("exits")).alias("rid"))
    doors = exits.unionByName(heads.select("rid")).distinct()
    steps = blocks.select("block", F.explode(F.arrays_zip("rids", "exits")).alias("x")).select("block", F.col("x.rids").alias("rid"), F.col("x.exits").alias("nxt"))
    steps = materialize(steps.join(doors, "rid", "left_semi"))
    jumps = [steps.select("rid", "nxt").distinct()]
    while True:
        j = jumps[-1]
        doubled = j.alias("a").join(j.alias("b"), F.col("a.nxt") == F.col("b.rid")).select(F.col("a.rid"), F.col("b.nxt"))
        doubled = materialize(doubled.distinct())
        if doubled.isEmpty():
            break
        jumps.append(doubled)
    entered = materialize(heads.select("rid").distinct())
    # after the jumps of length >= 2^(k+1) the set holds the chain positions that are multiples of
    # 2^(k+1); J_k adds those at 2^k past them
    for j in reversed(jumps):
        entered = materialize(entered.unionByName(entered.join(j, "rid").select(F.col("nxt").alias("rid"))).distinct())
    doors = steps.join(entered, "rid", "left_semi").groupBy("block").agg(F.collect_set("rid").alias("entered"))
    inside = blocks.join(doors, "block").select("rids", "places", "entered").mapInArrow(_walk_blocks, "rid long")
    return materialize(entered.unionByName(inside).distinct())


def kept_chain(r: DataFrame, chunk_seconds: int = CHUNK_SECONDS) -> tuple[DataFrame, DataFrame]:
    """Steps 1 to 5 over (key, t, s, rid, exp), materialized: requests in the order (t, s), their
    identity and the expiry of the job each would start.  The kept ids (rid), each once, and of every
    id the kept one that serves it (rid, prev)."""
    data = r.select("key", "t", "s", F.col("rid").alias("did"))
    # probe position: (exp, -1) when exp > t, else just after the request itself
    probes = r.select("key", F.when(F.col("exp") > F.col("t"), F.col("exp")).otherwise(F.col("t")).alias("t"),
                      F.when(F.col("exp") > F.col("t"), F.lit(-1).cast("long")).otherwise(F.col("s")).alias("s"),
                      F.col("rid").alias("pid"), F.col("t").alias("own_t"), F.col("s").alias("own_s"))
    nxt = asof_successor(data, probes, chunk_seconds, ("own_t", "own_s")).filter(F.col("did").isNotNull())
    jump = materialize(nxt.select("key", "own_t", "own_s", F.col("pid").alias("rid"), F.col("did").alias("nxt")))
    heads = r.groupBy("key").agg(F.min_by("rid", F.struct("t", "s")).alias("rid"))
    kept = reached(heads, jump, ["key", "own_t", "own_s"])
    marked = r.join(kept.withColumn("mark", F.lit(True)), "rid", "left").select(
        "key", "t", "s", "rid", F.coalesce(F.col("mark"), F.lit(False)).alias("mark"))
    return kept, asof_predecessor(marked, chunk_seconds)


def ttl_dedup(requests: DataFrame, key: str, ts: str, run_seconds: str, failed: str, rid: str,
              ttl_seconds: float = TTL_SECONDS, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Requests + ``kept`` (starts a new job) and ``job_request_id`` (the kept request whose
    job serves it).  ``key`` is the dedup key (normalized url); limits are not part of it."""
    r = requests.select(
        F.col(key).alias("key"), _micros(F.col(ts)).alias("t"), F.col(rid).cast("long").alias("s"),
        (_micros(F.col(ts)) + F.round(F.col(run_seconds) * 1_000_000).cast("long")
         + F.when(F.col(failed), F.lit(0)).otherwise(F.lit(int(ttl_seconds * 1_000_000)))).alias("exp"),
    )
    # requests that repeat one another are decided once
    r = materialize(r.distinct().withColumn("rid", F.col("s")))
    kept, prev = kept_chain(r, chunk_seconds)
    prev = prev.select(F.col("rid").alias("_rid"), F.col("prev").alias("_prev"))
    flags = kept.select(F.col("rid").alias("_kid"), F.lit(True).alias("_kept"))
    out = requests.join(prev, requests[rid].cast("long") == prev["_rid"]).join(flags, F.col("_rid") == F.col("_kid"), "left")
    return out.select(*[requests[c] for c in requests.columns], F.coalesce(F.col("_kept"), F.lit(False)).alias("kept"),
                      F.col("_prev").alias("job_request_id"))


def request_dedup(requests: DataFrame, ttl_seconds: float = TTL_SECONDS, key_cols: list[str] | None = None) -> DataFrame:
    """J1 + J2 over a requests table: valid requests keyed by normalized url.  The reference's key
    ignores the page / depth limits; ``key_cols`` (e.g. ["max_pages", "max_depth"]) adds them."""
    valid = validate_requests(requests).filter(F.col("reject_reason").isNull())
    valid = U.add_url_parts(valid, "accepted_url", "k")
    valid = U.drop_url_parts(U.add_normalized(valid, "k", "norm_url"), "k")
    key = "norm_url"
    if key_cols:
        valid = valid.withColumn("_key", F.to_json(F.struct("norm_url", *key_cols)))
        key = "_key"
    valid = materialize(valid)  # urls are split once, not for the chain and again for the rows
    out = ttl_dedup(valid, key, "requested_at", "run_seconds", "failed", "request_id", ttl_seconds)
    return out.drop("_key") if key_cols else out
