"""Sinks (K1-K3): one text document per site, named by hostname; the batch archive.

Files go to a partitioned folder (``hostname=<host>/part-*.txt``).  The text writer appends its
line separator after every value, so the document's own final newline is dropped first and the
written file is byte-exact.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.functions import urls as U
from sitefold.functions.plan import fenced_filter
from sitefold.session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder (never a machine-local temp)."""
    return os.path.join(checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex}")


def with_hostname(df: DataFrame, url: str = "root_url") -> DataFrame:
    """K3: hostname of the url: no userinfo, no port, lower case."""
    df = U.add_url_parts(df, url, "h")
    return U.drop_url_parts(df.withColumn("hostname", U.hostname_of("h")), "h")


def write_site_files(parts: DataFrame, path: str) -> None:
    """K1: one file per hostname under ``path``, its parts written in order by one task, a part at a
    time.  ``parts``: (site, root_url, part_no, text).  Of sites that share a hostname the last one
    (by ``pos`` when present, else by site) is written."""
    df = with_hostname(parts)
    order = F.col("pos") if "pos" in df.columns else F.col("site")
    chosen = df.groupBy("hostname").agg(F.max_by("site", order).alias("site"))
    df = df.join(chosen, ["hostname", "site"], "left_semi")
    # the text writer ends every value with a line end
    df = df.select("hostname", "part_no", F.regexp_replace("text", "\n\\z", "").alias("value"))
    df = df.repartition("hostname").sortWithinPartitions("hostname", "part_no")
    df.select("hostname", "value").write.mode("overwrite").partitionBy("hostname").text(path)


def read_site_files(spark: SparkSession, path: str) -> DataFrame:
    """Read the written documents back: (hostname, llms_txt), each file whole.  The schema is given,
    so a hostname stays a string whatever it looks like."""
    df = spark.read.schema("value string, hostname string").text(path, wholetext=True)
    return df.select("hostname", F.col("value").alias("llms_txt"))


def archive_entries(results: DataFrame) -> DataFrame:
    """K2: non-empty documents of a batch keyed ``<hostname>-llms.txt``; later rows win, and the
    number of documents each entry replaced is reported."""
    df = with_hostname(fenced_filter(results, F.col("llms_txt").isNotNull() & (F.col("llms_txt") != "")), "url")
    last = df.groupBy("batch_id", "hostname").agg(F.max_by("llms_txt", "pos").alias("llms_txt"), (F.count(F.lit(1)) - 1).alias("replaced"))
    return last.select("batch_id", F.concat(F.col("hostname"), F.lit("-llms.txt")).alias("entry"), "llms_txt", "replaced")
