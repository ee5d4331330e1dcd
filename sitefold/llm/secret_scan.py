"""Secret scan over an incremental blob ledger (DataFrame functions only).

Every version of a file is a *blob*, addressed by the SHA-256 of its content.  The ledger records
which (blob, rule, rule version) pairs have been scanned; a run scans the pairs the ledger lacks,
appends findings and ledger rows, and joins the findings of all blobs back to every path.

* Copies are scanned once: one path stands for its blob, the others only meet it in the last join,
  which carries digests and spans, no texts.
* Spans come from ``regexp_extract_all`` (the matches) and ``split`` (the gaps between them): both
  walk the same leftmost non-overlapping matches, so running sums of their lengths are the offsets.
* Findings are written before the ledger rows.  A run that dies in between scans those pairs again;
  readers take distinct findings.

Defined cases: null text = empty (no spans); repeated rows are repeated paths of one blob; several
rules may claim the same characters, each with its own span.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitefold.llm.common import new_dir, text_of

LEDGER_SCHEMA = "blob binary, rule string, version int"
FINDING_SCHEMA = "blob binary, rule string, version int, `start` long, `end` long"


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters; shorter matches are dropped, but still
    consume their text."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1


# The three base rules.  A maximal run of a class that is too short never holds a
# longer match, so the minimum of `access` and `hex` can stand in the pattern.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# Further kinds: private key headers and prefixed service tokens.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("prefixed", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|xox[abpr]-[A-Za-z0-9-]{10,})"),
)
RULES = BASE_RULES + MORE_RULES


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _matches(rule: Rule) -> Column:
    """array<struct<rule, version, pos, gap, len, val>> of one rule over the column ``text``."""
    pattern = F.lit(rule.pattern)
    whole = F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), F.length)
    value = F.transform(F.regexp_extract_all("text", pattern, F.lit(rule.group)), F.length) if rule.group else whole
    gaps = F.transform(F.split("text", rule.pattern, -1), F.length)
    zipped = F.transform(F.arrays_zip(whole.alias("len"), value.alias("val"), F.slice(gaps, F.lit(1), F.size(whole)).alias("gap")),
                         lambda x, i: F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version"),
                                               i.alias("pos"), x["gap"].alias("gap"), x["len"].alias("len"), x["val"].alias("val")))
    seen = F.array_contains("rules", F.lit(rule.name)) & F.col("text").rlike(rule.pattern)
    return F.when(seen, zipped).otherwise(F.array().cast("array<struct<rule:string,version:int,pos:int,gap:int,len:int,val:int>>"))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings of (blob, text, rules array<string>): offsets in code points, end exclusive."""
    hits = blobs.select("blob", F.concat(*[_matches(r) for r in rules]).alias("hits")).where(F.size("hits") > 0)
    # a blob whose path is listed twice was read twice
    hits = hits.select("blob", F.inline("hits")).repartition("blob", "rule").dropDuplicates(["blob", "rule", "pos"])
    before = Window.partitionBy("blob", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.least))])
    return (hits.withColumn("end", F.sum((F.col("gap") + F.col("len")).cast("long")).over(before))
            .where(F.col("val") >= least[F.col("rule")])
            .select("blob", "rule", "version", (F.col("end") - F.col("len")).alias("start"), "end"))


def _read(spark: SparkSession, path: str, schema: str, but: str | None = None) -> DataFrame:
    """The batches under ``path`` except batch ``but``; none yet is an empty table."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(conf).exists(hadoop):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch string").parquet(path)
    return (rows if but is None else rows.where(F.col("batch") != but)).drop("batch")


def scan_incremental(versions: DataFrame, ledger_dir: str, batch: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger under ``ledger_dir`` lacks for ``versions`` (doc_id, text), record it as
    batch ``batch`` (a rerun of one batch overwrites it) and return all findings."""
    spark = versions.sparkSession
    paths = versions.select("doc_id", text_of().alias("text")).withColumn("blob", blob_of(F.col("text")))
    ledger = _read(spark, f"{ledger_dir}/ledger", LEDGER_SCHEMA, but=batch)
    wanted = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    pairs = (paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
             .select("blob", "doc_id", F.inline(wanted)))
    unseen = (pairs.join(ledger, ["blob", "rule", "version"], "left_anti")
              .groupBy("blob", "doc_id").agg(F.collect_set("rule").alias("rules")))
    todo = unseen.withColumnRenamed("blob", "_blob").withColumnRenamed("doc_id", "_id")
    texts = paths.join(todo.hint("shuffle_hash"), paths["doc_id"].eqNullSafe(todo["_id"]) & (paths["blob"] == todo["_blob"]))
    findings = scan_blobs(texts.select("blob", "text", "rules"), rules)
    findings.write.mode("overwrite").parquet(f"{ledger_dir}/findings/batch={batch}")
    done = pairs.join(ledger, ["blob", "rule", "version"], "left_anti").select("blob", "rule", "version")
    done.write.mode("overwrite").parquet(f"{ledger_dir}/ledger/batch={batch}")
    return _read(spark, f"{ledger_dir}/findings", FINDING_SCHEMA).distinct()


def findings_by_path(versions: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per path with the counts and spans of its blob."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    base = [r.name for r in BASE_RULES]
    spans = (findings.withColumn("kind", order[F.col("rule")]).where(F.col("kind").isNotNull())
             .groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "rule"))).alias("s")))

    def joined(s: Column) -> Column:
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["rule"], x["start"], x["end"])), ",")

    per_blob = spans.select(
        F.col("blob").alias("_blob"),
        *[F.expr(f"cast(size(filter(s, x -> x.rule = '{n}')) as bigint)").alias(f"n_{n}") for n in base],
        F.sha2(joined(F.filter("s", lambda x: x["rule"].isin(base))), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))
    paths = versions.select("doc_id", blob_of(text_of()).alias("blob"))
    return paths.join(per_blob, paths["blob"] == per_blob["_blob"], "left").select(
        "doc_id", *[F.coalesce(F.col(f"n_{n}"), F.lit(0).cast("long")).alias(f"n_{n}") for n in base],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` against an empty ledger."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return findings_by_path(docs, scan_incremental(docs, new_dir(spark, "secret-ledger"), "first"))


def _sql_kind(i: int, name: str, pattern: str, flags: str, value_group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    value = f"regexp_extract_all(t, '{p}', {value_group}{flags})"
    return f"""
  SELECT t, {i} AS k, '{name}' AS kind, sum(gap + len) OVER (PARTITION BY t ORDER BY pos) AS e, len, val FROM (
    SELECT t, unnest(range(1, len(m) + 1)) AS pos, unnest(list_transform(m, lambda x: length(x))) AS len,
           unnest(list_transform(v, lambda x: length(x))) AS val,
           unnest(list_transform(g[1:len(m)], lambda x: length(x))) AS gap
    FROM (SELECT t, regexp_extract_all(t, '{p}', 0{flags}) AS m, {value} AS v, string_split_regex(t, '{p}'{flags}) AS g
          FROM b WHERE regexp_matches(t, '{p}'{flags}))) QUALIFY val >= {least}"""


OP3_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), b AS (SELECT DISTINCT t FROM d),
f AS (""" + " UNION ALL ".join([
    _sql_kind(0, "assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "", 2, 12),
    _sql_kind(1, "access", r"AKIA[A-Z0-9]+", "", 0, 18),
    _sql_kind(2, "hex", r"[0-9a-f]+", "", 0, 16),
    _sql_kind(3, "pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", "", 0, 0),
    _sql_kind(4, "prefixed", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|xox[abpr]-[A-Za-z0-9-]{10,})", "", 0, 0),
]) + """),
s AS (SELECT t, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
        string_agg(kind || ':' || (e - len)::BIGINT || ':' || e::BIGINT, ',' ORDER BY e - len, k) FILTER (k < 3) AS base,
        string_agg(kind || ':' || (e - len)::BIGINT || ':' || e::BIGINT, ',' ORDER BY e - len, k) AS spans
      FROM f GROUP BY t)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (t)
"""
