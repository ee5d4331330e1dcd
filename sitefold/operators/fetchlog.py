"""Fetch log folding (C7, C8): stored fetch attempts -> one outcome per url.

Each attempt is classified by one ``when`` chain (ok / final / retry, with its message and wait);
then one aggregation per url picks the first ok-or-final attempt, else the last retry error.  ``body`` names the reply's content (a page
id, a blob key): no html passes through the aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------
MAX_RETRIES = 2
RETRY_AFTER_DEFAULT = 5.0
RATE_LIMITED = "HTTP 429 (rate limited)"
# ----------------------------------------------------------------------------------------------


def classify_attempts(attempts: DataFrame, max_retries: int = MAX_RETRIES, key: str = "norm_url") -> DataFrame:
    """Per attempt: kind (ok / final / retry) and error message.  A non-numeric Retry-After ends the
    url with the conversion error."""
    last = max_retries
    a = attempts.filter(F.col("attempt") <= last)
    status, attempt = F.col("status"), F.col("attempt")
    ctype = F.coalesce(F.col("content_type"), F.lit(""))
    ra_text = F.coalesce(F.col("retry_after"), F.lit(str(RETRY_AFTER_DEFAULT)))
    ra = F.expr("try_cast(trim(coalesce(retry_after, '')) as double)")
    ra = F.when(F.col("retry_after").isNull(), F.lit(RETRY_AFTER_DEFAULT)).otherwise(ra)
    kind = (
        F.when(F.col("error_kind").isin("timeout", "connect"), F.lit("retry"))
        .when(F.col("error_kind").isNotNull(), F.lit("final"))
        .when(status == 200, F.when(F.instr(ctype, "text/html") > 0, F.lit("ok")).otherwise(F.lit("final")))
        .when(status == 429, F.when(ra.isNull(), F.lit("final")).otherwise(F.lit("retry")))
        .when((status >= 400) & (status < 500), F.lit("final"))
        .otherwise(F.lit("retry"))
    )
    error = (
        F.when(F.col("error_kind").isin("timeout", "connect"), F.concat(F.lit("timeout after "), (attempt + 1).cast("string"), F.lit(" attempt(s)")))
        .when(F.col("error_kind").isNotNull(), F.coalesce(F.col("error_text"), F.lit("")))
        .when(status == 200, F.when(F.instr(ctype, "text/html") > 0, F.lit(None).cast("string"))
              .otherwise(F.concat(F.lit("non-HTML content-type: "), F.substring_index(ctype, ";", 1))))
        .when(status == 429, F.when(ra.isNull(), F.concat(F.lit("could not convert string to float: '"), ra_text, F.lit("'")))
              .otherwise(F.lit(RATE_LIMITED)))
        .otherwise(F.concat(F.lit("HTTP "), status.cast("string")))
    )
    return a.select(key, attempt.alias("attempt"), kind.alias("kind"), error.alias("error"), "body")


def fetch_outcomes(attempts: DataFrame, max_retries: int = MAX_RETRIES, key: str = "norm_url") -> DataFrame:
    """fetch_outcome(key, ok, body, error, attempts_used).

    First ok-or-final attempt wins; otherwise the last retry's error.
    """
    c = classify_attempts(attempts, max_retries, key)
    terminal = F.col("kind").isin("ok", "final")
    per = c.groupBy(key).agg(
        F.min(F.when(terminal, F.col("attempt"))).alias("t"),
        F.min_by(F.struct("kind", "error"), F.when(terminal, F.col("attempt"))).alias("term"),
        F.max_by("error", F.when(F.col("kind") == "retry", F.col("attempt"))).alias("last_retry"),
        F.max("attempt").alias("last"),
        F.min_by("body", F.when(F.col("kind") == "ok", F.col("attempt"))).alias("first_ok_body"),
    )
    t = F.col("t")
    ok = F.coalesce(F.col("term.kind") == "ok", F.lit(False))
    return per.select(
        key,
        ok.alias("ok"),
        F.when(ok, F.col("first_ok_body")).alias("body"),
        F.when(t.isNotNull(), F.col("term.error")).otherwise(F.coalesce(F.col("last_retry"), F.lit("unknown error"))).alias("error"),
        F.when(t.isNotNull(), t + 1).otherwise(F.col("last") + 1).cast("int").alias("attempts_used"),
    )
