"""Job, batch, request and seed-list tables derived from ``orders``, ``lineitem``, ``events`` and
``pages`` by fixed rules (SURVEY 7.2).  Deterministic, so the DuckDB oracle rebuilds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.sources.sinks import scratch_path
from sitefold.sources.tables import read_table

# --- fixed values -----------------------------------------------------------------------------
DEFAULT_MAX_PAGES = 50
DEFAULT_MAX_DEPTH = 3
# the moment "now" for listings and cache ages (a parameter everywhere; this is the default)
AS_OF = "2001-09-01 00:00:00"
SEED_FILE_LINES = 1000  # pages of one derived seed file
CUSTOMERS_PER_SUBMISSION = 25
BAD_BYTES = ("FF", "C3", "C0AF", "EDA080")  # a stray byte, a cut, an overlong and a surrogate sequence
# ----------------------------------------------------------------------------------------------


def _secs(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)"))


def job_url(key: Column) -> Column:
    """Url of a job: one of 500 hosts from the order key, spelled four ways (case, trailing slash)."""
    host = F.concat(F.when(key % 4 == 1, F.lit("WWW.")).otherwise(F.lit("www.")), F.lit("c"),
                    (F.floor(key / 4) % 500).cast("string"), F.lit(".example.com"))
    return F.concat(F.lit("https://"), host, F.when(key % 2 == 0, F.lit("/")).otherwise(F.lit("")))


def batch_starts(orders: DataFrame) -> DataFrame:
    """(batch_id, batch_start): a customer's orders with key % 3 = 0 form a batch, submitted 0, 60
    or 120 s after the first of them."""
    return orders.where(F.col("o_orderkey") % 3 == 0).groupBy(F.col("o_custkey").alias("batch_id")).agg(
        F.min("o_orderdate").alias("first")).select("batch_id", (F.col("first") + _secs(F.col("batch_id") % 3 * 60)).alias("batch_start"))


def jobs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jobs(job_id, url, status, pages_crawled, pages_skipped, parent_batch_id, max_pages,
    max_depth, submitted_at, started_at, completed_at, error, customer): one job per order; F -> done,
    O -> running, P -> pending, key % 10 = 0 -> error, = 1 -> cancelled; children of batch
    o_custkey when key % 6 = 0 (half of the batch's urls), submitted when the batch starts or later;
    lineitems are page results (R -> skipped)."""
    return jobs_from_orders(spark, sf_dir, read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"]))


def job_status(key: Column, order_status: Column) -> Column:
    return (F.when(key % 10 == 0, F.lit("error")).when(key % 10 == 1, F.lit("cancelled"))
            .when(order_status == "F", F.lit("done")).when(order_status == "O", F.lit("running")).otherwise(F.lit("pending")))


def _submitted() -> Column:
    """When the job of an order with its ``batch_start`` is submitted."""
    return F.when(F.col("o_orderkey") % 6 == 0, F.greatest("o_orderdate", "batch_start")).otherwise(F.col("o_orderdate"))


def jobs_from_orders(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    """The jobs rule applied to an orders frame (batch or streaming; the other tables are read static)."""
    lines = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_returnflag"]).groupBy("l_orderkey").agg(
        F.count_if(F.col("l_returnflag") != "R").alias("ok_lines"), F.count_if(F.col("l_returnflag") == "R").alias("r_lines"))
    starts = batch_starts(read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"]))
    df = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").fillna({"ok_lines": 0, "r_lines": 0})
    df = df.join(starts, df.o_custkey == starts.batch_id, "left")
    key = F.col("o_orderkey")
    status = job_status(key, F.col("o_orderstatus"))
    df = df.withColumns({"status": status, "submitted_at": _submitted()})
    df = df.withColumn("started_at", F.when(F.col("status") != "pending", F.col("submitted_at") + _secs(key % 50)))
    terminal = F.col("status").isin("done", "error", "cancelled")
    completed = F.when(terminal, F.col("started_at") + _secs(F.col("ok_lines") * 2 + key % 7 + F.lit(0.25)))
    return df.select(
        key.alias("job_id"), job_url(key).alias("url"), "status",
        F.when(F.col("status") == "pending", 0).otherwise(F.col("ok_lines")).cast("long").alias("pages_crawled"),
        F.when(F.col("status") == "pending", 0).otherwise(F.col("r_lines")).cast("long").alias("pages_skipped"),
        F.when(key % 6 == 0, F.col("o_custkey")).alias("parent_batch_id"),
        F.lit(DEFAULT_MAX_PAGES).alias("max_pages"), F.lit(DEFAULT_MAX_DEPTH).alias("max_depth"),
        "submitted_at", "started_at", completed.alias("completed_at"),
        F.when(F.col("status") == "error", F.concat(F.lit("Could not reach "), job_url(key), F.lit(": HTTP 503"))).alias("error"),
        F.col("o_custkey").alias("customer"),
    )


def job_pages_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the pages that done jobs crawled, in ``page_meta``'s columns with the job id as site:
    one for each line number with a line item that counts as a page (the least part key).  Line 1 is the root; titles of lines with number % 4 != 0
    carry the host as suffix, number % 5 = 0 has no description."""
    from sitefold.functions import urls as U
    from sitefold.operators.pages import META_COLUMNS

    jobs = jobs_table(spark, sf_dir).where(F.col("status") == "done").select("job_id", F.col("url").alias("root"))
    lines = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag", "l_partkey"]).where(F.col("l_returnflag") != "R")
    lines = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    df = lines.join(jobs, F.col("l_orderkey") == F.col("job_id"))
    number, host = F.col("l_linenumber"), F.lower(F.regexp_replace("root", "^https://|/$", ""))
    section = F.when(number % 3 == 0, "docs/").when(number % 3 == 1, "blog-posts/").otherwise("")
    title = F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))
    df = df.select(
        F.col("job_id").cast("string").alias("site"), number.cast("long").alias("page_ord"),
        F.when(number == 1, F.col("root")).otherwise(F.concat(F.lit("https://"), host, F.lit("/"), section, F.lit("p"), number.cast("string"))).alias("url"),
        F.when(number % 4 != 0, F.concat(title, F.lit(" | "), host)).otherwise(title).alias("title"),
        F.when(number % 5 != 0, F.concat(F.lit("Line "), number.cast("string"), F.lit(" of job "), F.col("job_id").cast("string"))).alias("description"),
        F.lit(None).cast("string").alias("h1"), F.when(number == 1, 0).otherwise(1).alias("depth"))
    df = U.add_normalized(U.add_url_parts(df, "url", "u"), "u", "norm_url").withColumn("path_prefix", U.path_prefix_of("u"))
    return U.drop_url_parts(df, "u").withColumn("has_description", F.col("description").isNotNull()).select(*META_COLUMNS)


def job_events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_events(job_id, at, seq, kind, error): the log behind ``jobs_table``.  A job's submission, start
    and end or failure are events; key % 21 = 0 is submitted and key % 15 = 0 ended twice.  A job that
    is to end as cancelled is cancelled as it starts; every line item with flag R asks for a cancel up
    to 80 s after the submission -- of a job that doesn't exist when its line number is 6."""
    jobs = jobs_table(spark, sf_dir)
    key, none = F.col("job_id"), F.lit(None).cast("string")
    status = F.col("status")

    def event(when: Column, at: Column, seq: int, kind: str, error: Column = none) -> Column:
        return F.when(when, F.struct(at.alias("at"), F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), error.alias("error")))

    own = F.array(
        event(F.lit(True), F.col("submitted_at"), 0, "submit"),
        event(key % 21 == 0, F.col("submitted_at") + _secs(F.lit(5)), 1, "submit"),
        event(F.col("started_at").isNotNull(), F.col("started_at"), 10, "start"),
        event(status == "cancelled", F.col("started_at"), 20, "cancel"),
        event(status.isin("done", "cancelled"), F.col("completed_at"), 30, "end"),
        event(status == "error", F.col("completed_at"), 31, "fail", F.col("error")),
        event(status.isin("done", "cancelled", "error") & (key % 15 == 0), F.col("completed_at") + _secs(F.lit(10)), 32, "end"),
    )
    out = jobs.select("job_id", F.explode(own).alias("e")).where(F.col("e").isNotNull()).select("job_id", "e.*")
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    starts = batch_starts(orders)
    times = orders.join(starts, orders.o_custkey == starts.batch_id, "left").select(F.col("o_orderkey").alias("job_id"), _submitted().alias("submitted_at"))
    lines = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag"]).where(F.col("l_returnflag") == "R")
    number = F.col("l_linenumber")
    after = (F.col("l_orderkey") * 7 + number * 13) % 80 + F.when(number % 2 == 1, F.lit(0.25)).otherwise(F.lit(0))
    asked = lines.join(times, F.col("l_orderkey") == F.col("job_id")).select(
        F.when(number == 6, -F.col("job_id")).otherwise(F.col("job_id")).alias("job_id"), (F.col("submitted_at") + _secs(after)).alias("at"),
        (number + 40).cast("int").alias("seq"), F.lit("cancel").alias("kind"), none.alias("error"))
    return out.unionByName(asked)


def batches_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batches(batch_id, batch_urls, max_pages, max_depth, submitted_at, cancel_requested): one
    batch per customer; its urls in order of the keys (a request's own list)."""
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    items = orders.where(F.col("o_orderkey") % 3 == 0).groupBy(F.col("o_custkey").alias("batch_id")).agg(
        F.transform(F.sort_array(F.collect_list("o_orderkey")), job_url).alias("batch_urls"))
    return items.join(batch_starts(orders), "batch_id").select(
        "batch_id", "batch_urls", F.lit(DEFAULT_MAX_PAGES).alias("max_pages"), F.lit(DEFAULT_MAX_DEPTH).alias("max_depth"),
        F.col("batch_start").alias("submitted_at"), (F.col("batch_id") % 5 == 0).alias("cancel_requested"))


def requests_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """requests(request_id, url, requested_at, run_seconds, failed, max_pages, max_depth) from
    ``events``: url from user_id (four spellings of one host), job run time = value seconds,
    event_type 'error' -> the job fails; limits spread over valid and invalid values."""
    return requests_from_events(read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"]))


def requests_from_events(ev: DataFrame) -> DataFrame:
    """The requests rule applied to an events frame (batch or streaming)."""
    uid, eid = F.col("user_id"), F.col("event_id")
    host = F.concat(F.when(eid % 3 == 0, F.lit("U")).otherwise(F.lit("u")), (uid % 300).cast("string"), F.lit(".example.org"))
    url = (F.when(eid % 97 == 0, F.concat(F.lit("not-a-url-"), eid.cast("string")))
           .when(eid % 89 == 0, F.concat(F.lit("ftp://"), host, F.lit("/")))
           .otherwise(F.concat(F.lit("https://"), host, F.when(eid % 2 == 0, F.lit("/")).otherwise(F.lit("")))))
    return ev.select(
        eid.alias("request_id"), url.alias("url"), F.col("ts").alias("requested_at"),
        F.abs(F.col("value")).cast("double").alias("run_seconds"), (F.col("event_type") == "error").alias("failed"),
        (eid % 230 - 10).cast("int").alias("max_pages"), (eid % 13).cast("int").alias("max_depth"),
    )


def seed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seed_lines(source_no, line_no, line): uploaded files (source 0) and form texts (source 1) built
    from page urls: some lines hold two urls joined by ',', some are junk, every url appears in both
    sources.  A file holds the lines of 1,000 page ids, an empty one for an id without a page; it is
    written as bytes and read through ``read_uploads``, so line_no is the page id again."""
    from sitefold.operators.batches import read_uploads, text_lines

    pages = read_table(spark, sf_dir, "pages", ["page_id", "url"])
    pid = F.col("page_id")
    line = (F.when(pid % 7 == 0, F.concat(F.lit("not a url "), pid.cast("string")))
            .when(pid % 5 == 0, F.concat(F.lit("  "), F.col("url"), F.lit(" ,, "), F.col("url"), F.lit("#dup")))
            .when(pid % 11 == 0, F.concat(F.lit("HTTPS://x"), pid.cast("string"), F.lit(".example.com")))
            .otherwise(F.col("url")))
    n = SEED_FILE_LINES
    lines = pages.select(F.floor(pid / n).alias("part"), (pid % n).cast("int").alias("at"), line.alias("line"))
    files = lines.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("at", "line"))).alias("m"))
    content = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(""))), "\n")
    path = scratch_path(spark, "seed-files")
    files.select("part", content.alias("value")).write.partitionBy("part").text(path)
    read = read_uploads(spark, path).select("text", F.regexp_extract("path", r"part=(-?[0-9]+)/", 1).cast("long").alias("part"))
    file_src = text_lines(read, 0, "part").filter(F.col("line_no") < n).select("source_no", (F.col("part") * n + F.col("line_no")).alias("line_no"), "line")
    form_src = pages.select(F.lit(1).alias("source_no"), (-pid).alias("line_no"), F.col("url").alias("line"))
    return file_src.unionByName(form_src)


def submissions_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """submissions(submission, max_pages, max_depth, submitted_at), uploads(submission, text) and
    forms(submission, text), from the orders with key % 5 = 2 of 25 customers each.  Even keys are in the
    file, odd keys and every third in the form, by key; some lines are junk, hold two urls or end in
    broken UTF-8, and every ninth submission has no url.  Files are written as bytes, packed into a table
    because there is one for every submission, and read back."""
    from sitefold.operators.batches import read_uploads

    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"]).where(F.col("o_orderkey") % 5 == 2)
    key, sub = F.col("o_orderkey"), F.floor(F.col("o_custkey") / CUSTOMERS_PER_SUBMISSION).cast("long")
    url, bad = job_url(key), F.array(*[F.unhex(F.lit(x)).cast("string") for x in BAD_BYTES])
    line = (F.when(sub % 9 == 0, F.concat(F.lit("HTTPS://"), key.cast("string")))
            .when(key % 7 == 0, F.concat(F.lit("no url "), key.cast("string")))
            .when(key % 11 == 0, F.concat(F.lit("  "), url, F.lit(" ,, "), url, F.lit("#x ")))
            .when(key % 13 == 0, F.concat(url, F.lit("/"), F.get(bad, (key % 4).cast("int"))))
            .otherwise(url))
    rows = orders.select(sub.alias("submission"), key.alias("key"), line.alias("line"), "o_orderdate")

    def text(part: DataFrame) -> DataFrame:
        own = F.transform(F.sort_array(F.collect_list(F.struct("key", "line"))), lambda x: x["line"])
        return part.groupBy("submission").agg(F.array_join(own, "\n").alias("text"))

    path = scratch_path(spark, "uploads")
    file = F.concat(F.lit("submission="), F.col("submission").cast("string"), F.lit("/seeds.txt"))
    text(rows.where("key % 2 = 0")).select(file.alias("path"), F.concat("text", F.lit("\n")).cast("binary").alias("content")).write.parquet(path)
    uploads = read_uploads(spark, path, packed=True).select(F.regexp_extract("path", r"submission=([0-9]+)/", 1).cast("long").alias("submission"), "text")
    forms = text(rows.where("key % 2 = 1 or key % 3 = 0")).withColumn("text", F.make_valid_utf8("text"))
    table = rows.groupBy("submission").agg((F.max("o_orderdate") + _secs(F.lit(600))).alias("submitted_at"))
    limits = table.select("submission", (F.col("submission") * 37 % 230 - 10).cast("int").alias("max_pages"),
                          (F.col("submission") % 12).cast("int").alias("max_depth"), "submitted_at")
    return limits, uploads, forms
