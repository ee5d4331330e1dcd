"""Structured Streaming forms of the continuous behaviours.

* X1 ``stream_request_dedup``: TTL dedup of arriving requests.  Every micro-batch goes through the
  library's chunked TTL dedup (``operators.requests.kept_chain``) behind one row per url that stands
  for its running job, so no url's requests are held in one task and the result does not depend on
  how rows are dealt.  State per normalized url = (expiry, job request id, newest request seen), an
  append-only log (``statelog``): a micro-batch reads and writes the rows of its own urls.  No request
  is dropped: one that arrives behind a newer one of its url comes out flagged ``late``.  Time is that
  of the requests, so a replay gives the same result: a url's row goes when its expiry and newest
  request are ``lateness_seconds`` behind the newest request of the micro-batches before; a request
  that is no later than that starts a new job then, as it would with the row.
* X2 ``stream_job_metrics``: jobs and their page results arrive as two streams and meet, in any order,
  in a log of one row per job: an outer join kept up to date.  A micro-batch adds to the metrics what
  the jobs it touched count now less what they counted before; page results of a job that has not
  arrived wait in the log.  ``stream_job_progress``: a streaming aggregation in update mode; every
  micro-batch writes the rows that changed, readers take the latest of each key.
* X3 ``stream_terminal_results``: append-only stream of finished batch children.

A micro-batch writes to a folder of its own (``epoch=<n>``) in overwrite mode, so a batch that runs
again after a failure replaces its rows instead of repeating them.  Folders lie under the shared
checkpoint folder; queries run with ``availableNow``, so a test or a scheduled job drains the input
and stops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.functions import urls as U
from sitefold.functions.plan import materialize
from sitefold.operators.jobs import epoch_micros
from sitefold.operators.requests import TTL_SECONDS, kept_chain, validate_requests
from sitefold.sources.sinks import scratch_path
from sitefold.sources.tables import table_path
from sitefold.streaming.statelog import StateLog

DEDUP_SCHEMA = "request_id long, norm_url string, kept boolean, job_request_id long, late boolean"
DEDUP_STATE = "norm_url string, exp long, job long, newest long"
JOB_STATE = "job_id long, status string, ok_lines long, r_lines long"


def run_epochs(rows: DataFrame, path: str, mode: str, step: Callable[[DataFrame, int], DataFrame] | None = None,
               schema: str | None = None) -> DataFrame:
    """Drain ``rows`` into ``path``, one folder per micro-batch; the table, with its ``epoch``.
    ``step`` makes the rows to write, of ``schema``, from a micro-batch and its number."""
    spark = rows.sparkSession
    none = spark.createDataFrame([], schema or rows.schema)
    none.write.mode("overwrite").parquet(f"{path}/epoch=-1")  # no input yet is an empty table

    def sink(batch: DataFrame, epoch: int) -> None:
        (step(batch, epoch) if step else batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    query = (rows.writeStream.outputMode(mode).foreachBatch(sink)
             .option("checkpointLocation", path + "-ckpt").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(none.schema.add("epoch", "long")).parquet(path)


def _stream(spark: SparkSession, sf_dir: str, name: str, columns: list[str], source: str | None = None) -> DataFrame:
    """File stream of a table; ``source`` (a glob) overrides the table file."""
    schema = spark.read.parquet(source or table_path(sf_dir, name)).select(*columns).schema
    # a glob path: the file source then watches the matching files instead of treating the
    # single file as its base folder
    glob = source or table_path(sf_dir, name)[:-1] + "[t]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(glob).select(*columns)


def _dedup_step(ttl_seconds: float, lateness_seconds: float, path: str) -> Callable[[DataFrame, int], DataFrame]:
    ttl_us, late_us = int(ttl_seconds * 1_000_000), int(lateness_seconds * 1_000_000)
    log = StateLog(path, DEDUP_STATE, "norm_url")

    def step(batch: DataFrame, epoch: int) -> DataFrame:
        spark = batch.sparkSession
        batch = materialize(batch)
        # the newest request of the micro-batches before, and now; one row an epoch
        marks = f"{path}/mark"
        high = spark.read.schema("high long").parquet(f"{marks}/epoch={epoch - 1}").first()["high"] if epoch else None
        newest = batch.agg(F.max("t")).first()[0]
        spark.createDataFrame([(max((x for x in (high, newest) if x is not None), default=None),)], "high long").coalesce(1).write.mode(
            "overwrite").parquet(f"{marks}/epoch={epoch}")
        live = F.lit(True) if high is None else F.greatest("exp", "newest") + late_us >= high
        log.compact(spark, epoch, live)
        first = batch.groupBy("norm_url").agg(F.min("t").alias("first"), F.max("t").alias("last"))
        state = materialize(log.before(spark, epoch, first).where(live))
        exp = F.col("t") + F.col("run_us") + F.when(F.col("failed"), F.lit(0)).otherwise(F.lit(ttl_us))
        # rows that repeat one another are decided once
        rows = batch.withColumn("exp", exp).groupBy(F.col("norm_url").alias("key"), "t", F.col("request_id").alias("s"), "exp").agg(
            F.count(F.lit(1)).alias("times"))
        # the running job of a url serves whatever comes before its expiry: a kept row before all others
        running = state.join(first, "norm_url").select(
            F.col("norm_url").alias("key"), (F.col("first") - 1).alias("t"), F.col("job").alias("s"), "exp", F.lit(0).cast("long").alias("times"))
        r = materialize(rows.unionByName(running).withColumn("rid", F.monotonically_increasing_id()))
        kept, served = kept_chain(r)
        jobs = r.select(F.col("rid").alias("prev"), F.col("s").alias("job"))
        decided = materialize(r.join(served, "rid").join(jobs, "prev").join(kept.withColumn("kept", F.lit(True)), "rid", "left")
                              .withColumn("kept", F.coalesce("kept", F.lit(False))))
        last = decided.where("kept").groupBy(F.col("key").alias("norm_url")).agg(F.max_by(F.struct("exp", "job"), F.struct("t", "s")).alias("k"))
        log.write(last.join(first, "norm_url").join(state.select("norm_url", "newest"), "norm_url", "left").select(
            "norm_url", "k.exp", "k.job", F.greatest("newest", "last").alias("newest")), epoch)
        out = decided.where("times > 0").withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).join(
            state.select(F.col("norm_url").alias("key"), "newest"), "key", "left")
        return out.select(F.col("s").alias("request_id"), F.col("key").alias("norm_url"), "kept", F.col("job").alias("job_request_id"),
                          F.coalesce(F.col("t") < F.col("newest"), F.lit(False)).alias("late"))

    return step


def stream_request_dedup(spark: SparkSession, sf_dir: str, lateness_seconds: float, ttl_seconds: float = TTL_SECONDS,
                         source: str | None = None) -> DataFrame:
    """Streaming TTL dedup over the requests derived from ``events`` (or the event files
    matching ``source``, one file per micro-batch); returns the sink table."""
    from sitefold.sources import jobtables as T

    ev = _stream(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"], source)
    reqs = T.requests_from_events(ev)
    valid = validate_requests(reqs).filter(F.col("reject_reason").isNull())
    valid = U.add_url_parts(valid, "accepted_url", "k")
    valid = U.drop_url_parts(U.add_normalized(valid, "k", "norm_url"), "k")
    valid = valid.select("request_id", "norm_url", epoch_micros(F.col("requested_at")).alias("t"),
                         F.round(F.col("run_seconds") * 1_000_000).cast("long").alias("run_us"), "failed")
    path = scratch_path(spark, "stream_dedup")
    return run_epochs(valid, path, "append", _dedup_step(ttl_seconds, lateness_seconds, path + "-state"), DEDUP_SCHEMA).drop("epoch")


def _metrics_step(path: str, state_path: str) -> Callable[[DataFrame, int], DataFrame]:
    from sitefold.operators.jobs import job_metrics

    log = StateLog(state_path, JOB_STATE, "job_id")

    def counted(rows: DataFrame) -> DataFrame:
        """J5 of jobs that have arrived; a pending job has no pages yet."""
        pages = [F.when(F.col("status") != "pending", F.col(c)).otherwise(0).alias(n) for c, n in (("ok_lines", "pages_crawled"), ("r_lines", "pages_skipped"))]
        return job_metrics(rows.where(F.col("status").isNotNull()).select("status", *pages))

    def step(batch: DataFrame, epoch: int) -> DataFrame:
        spark = batch.sparkSession
        log.compact(spark, epoch)
        new = materialize(batch.groupBy("job_id").agg(F.max("status").alias("status"), F.sum("ok").alias("ok_lines"), F.sum("r").alias("r_lines")))
        old = materialize(log.before(spark, epoch, new))
        both = new.unionByName(old).groupBy("job_id").agg(F.max("status").alias("status"), F.sum("ok_lines").alias("ok_lines"), F.sum("r_lines").alias("r_lines"))
        both = materialize(both)
        log.write(both, epoch)
        # the row as it stood, plus what the touched jobs count now, less what they counted
        rows = counted(both).unionByName(counted(old).select(*[(-F.col(c)).alias(c) for c in counted(old).columns]))
        if epoch:
            rows = rows.unionByName(spark.read.parquet(f"{path}/epoch={epoch - 1}"))
        return rows.agg(*[F.sum(c).cast("long").alias(c) for c in rows.columns])

    return step


def stream_job_metrics(spark: SparkSession, sf_dir: str, orders_source: str | None = None, lines_source: str | None = None) -> DataFrame:
    """The J5 metrics row over arriving orders (jobs) and line items (their page results), two
    streams; the last micro-batch has the row as it stands."""
    from sitefold.operators.jobs import job_metrics
    from sitefold.sources import jobtables as T

    orders = _stream(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus"], orders_source)
    lines = _stream(spark, sf_dir, "lineitem", ["l_orderkey", "l_returnflag"], lines_source)
    none, skipped = F.lit(0).cast("long"), F.col("l_returnflag") == "R"
    jobs = orders.select(F.col("o_orderkey").alias("job_id"), T.job_status(F.col("o_orderkey"), F.col("o_orderstatus")).alias("status"),
                         none.alias("ok"), none.alias("r"))
    pages = lines.select(F.col("l_orderkey").alias("job_id"), F.lit(None).cast("string").alias("status"),
                         F.when(skipped, 0).otherwise(1).cast("long").alias("ok"), F.when(skipped, 1).otherwise(0).cast("long").alias("r"))
    path = scratch_path(spark, "stream_metrics")
    empty = job_metrics(spark.createDataFrame([], "status string, pages_crawled long, pages_skipped long"))
    schema = ", ".join(f"{c} long" for c in empty.columns)
    metrics = run_epochs(jobs.unionByName(pages), path, "append", _metrics_step(path, path + "-state"), schema)
    return metrics.unionByName(empty.withColumn("epoch", F.lit(-2).cast("long"))).orderBy(F.col("epoch").desc()).limit(1).drop("epoch")


def latest_by_key(changes: DataFrame, key: str) -> DataFrame:
    """The latest row of each key of a table of changes by epoch."""
    rest = [c for c in changes.columns if c not in (key, "epoch")]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*rest), "epoch").alias("_r"))
    return last.select(key, *[F.col("_r")[c].alias(c) for c in rest])


def stream_job_progress(spark: SparkSession, sf_dir: str, source: str | None = None) -> DataFrame:
    """X2 per job: live crawled / skipped page counters as page results arrive (lineitem rows are
    the page results of a job, 'R' = skipped); a micro-batch writes the jobs it changed."""
    lines = _stream(spark, sf_dir, "lineitem", ["l_orderkey", "l_returnflag"], source)
    progress = lines.groupBy(F.col("l_orderkey").alias("job_id")).agg(
        F.count_if(F.col("l_returnflag") != "R").alias("pages_crawled"),
        F.count_if(F.col("l_returnflag") == "R").alias("pages_skipped"),
    )
    return latest_by_key(run_epochs(progress, scratch_path(spark, "stream_progress"), "update"), "job_id")


def stream_terminal_results(spark: SparkSession, sf_dir: str, source: str | None = None) -> DataFrame:
    """A result row is appended when a batch child reaches a final state."""
    from sitefold.sources import jobtables as T

    orders = _stream(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"], source)
    jobs = T.jobs_from_orders(spark, sf_dir, orders)
    done = jobs.filter(F.col("parent_batch_id").isNotNull() & F.col("status").isin("done", "error", "cancelled"))
    rows = done.select(F.col("parent_batch_id").alias("batch_id"), "job_id", "url", "status",
                       F.when(F.col("status") == "done", F.col("pages_crawled")).alias("page_count"), "error")
    return run_epochs(rows, scratch_path(spark, "stream_results"), "append").drop("epoch")
