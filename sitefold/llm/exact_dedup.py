"""Exact dedup through an extendible-hash index on shared files (DataFrame functions only).

Texts are equal when identical after white-space normalisation.  The index has a directory over the
64-bit hashes of the normalised texts and a file of entries for each bucket; every decision is an
entry of it:

1. *Directory.*  Distinct hashes are counted per cell (top bits of the hash).  The directory doubles
   wherever a bucket holds more than ``capacity`` keys, from depth 0 on; a cell points to the bucket of
   the least depth that fits.  Cells have 16 bits, and more as long as one of them is overfull, so
   no bucket overflows: distinct hashes part at last.
2. *Owner tasks.*  Whole texts are dealt by bucket, so a task owns the key ranges of its buckets.  It
   chains the texts that share a hash and compares them byte for byte; every link is an entry: the
   text's SHA-256, the id that stays and the number of rows.  A hash that many rows share is
   dealt to several tasks, each of which chains its part; only their links, a few for such a hash, are
   compared once more.
3. *Files.*  Entries lie in bucket order on the shared folder.
4. *Lookup.*  Every document finds its bucket through the directory and its link by hash and SHA-256.
   No text moves there; adaptive execution splits hot keys.

There are ``BUCKETS_PER_TASK`` buckets for each shuffle partition unless a ``capacity`` is given, so the
directory follows the cluster, not the data; it is broadcast up to ``MOST_CELLS`` cells and joined
beyond.  So few hashes count as hot (four for each partition at most) that these are broadcast too.

Defined cases: null text = empty text (all empty texts are equal); a null id loses against any
other id; rows repeated under one id are one document and carry the same decision.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitefold.llm.common import new_dir, stored, text_of, wrapped

#: Bits of a cell, unless a cell of that size is overfull.
CELL_BITS = 16
MOST_CELLS = 1 << 20
#: Buckets for each task, so that their sizes even out.
BUCKETS_PER_TASK = 8
#: A hash with more rows than that, and than a quarter of a task's share, is dealt to several tasks.
HOT_ROWS = 2_000


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space.  Single spaces already are, so they don't match."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _cell(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits).cast("long")


def directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """((cell, depth, bucket), bits of a cell): extendible hashing's directory over the distinct key
    hashes ``_h``; a bucket's name is (depth, bucket), the top ``depth`` bits of its keys."""
    bits = CELL_BITS
    while True:
        cells = stored(keys.groupBy(_cell(F.col("_h"), bits).alias("cell")).agg(F.count(F.lit(1)).alias("n")), "exact-cells")
        full = cells.agg(F.max("n").alias("n"), F.sum("n").alias("keys")).first()
        if full["n"] is None or full["n"] <= capacity or bits >= 60:
            break
        bits = min(60, max(bits + 4, math.ceil(math.log2(full["keys"] / capacity)) + 4))
    levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    levels = levels.withColumn("bucket", F.expr(f"shiftright(cell, {bits} - depth)"))
    sums = levels.groupBy("depth", "bucket").agg((F.sum("n") <= capacity).alias("fits"), F.collect_list("cell").alias("cells"))
    fits = sums.where(F.col("fits") | (F.col("depth") == bits))
    least = fits.select("depth", F.explode("cells").alias("cell")).groupBy("cell").agg(F.min("depth").alias("depth"))
    return least.withColumn("bucket", F.expr(f"shiftright(cell, {bits} - depth)")), bits


def _keys(docs: DataFrame) -> DataFrame:
    """Per document its hash and SHA-256, evaluated on the normalised text."""
    norm = docs.select("doc_id", normalised(text_of()).alias("_norm"))
    return stored(norm.select("doc_id", F.xxhash64("_norm").alias("_h"), F.sha2("_norm", 256).alias("_sha")), "exact-keys")


def build_index(docs: DataFrame, capacity: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(directory, entries) of the index, both on shared files."""
    return _indexed(docs, _keys(docs), capacity)[:2]


def _indexed(docs: DataFrame, seek: DataFrame, capacity: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(directory, entries, ``seek`` with the bucket of each row)."""
    spark = docs.sparkSession
    rows = stored(seek.groupBy("_h").agg(F.count(F.lit(1)).alias("rows")), "exact-hashes")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = rows.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    if capacity is None:
        capacity = -(-n["keys"] // (BUCKETS_PER_TASK * tasks))
    pointers, bits = directory(rows, max(1, capacity))
    pointers = stored(pointers, "exact-directory")
    cells = F.broadcast(pointers) if pointers.count() <= MOST_CELLS else pointers

    def found(df: DataFrame) -> DataFrame:
        return df.withColumn("cell", _cell(F.col("_h"), bits)).join(cells, "cell")

    norm = docs.select("doc_id", normalised(text_of()).alias("_norm")).withColumn("_h", F.xxhash64("_norm"))
    # rows / most of them, so 4 * tasks, at most: the bound of this broadcast
    most = max(HOT_ROWS, -(-n["rows"] // (4 * tasks)))
    hot = rows.where(F.col("rows") > most).select(F.col("_h").alias("_hot"), F.ceil(F.col("rows") / most).alias("_tasks"))
    dealt = found(norm).join(F.broadcast(hot), F.col("_h") == F.col("_hot"), "left")
    dealt = dealt.withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("_tasks"))).cast("int"))
    owned = dealt.select("depth", "bucket", "_salt", "_h", "_norm", F.col("_hot").isNotNull().alias("_part"), "doc_id").repartition("depth", "bucket", "_salt")
    links = owned.groupBy("depth", "bucket", "_salt", "_h", "_part", "_norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    links = links.select("depth", "bucket", "_h", F.sha2("_norm", 256).alias("_sha"), "_part", F.when(F.col("_part"), F.col("_norm")).alias("_norm"),
                         "keep_id", "group_size")
    links = stored(links, "exact-links")
    whole = links.where(~F.col("_part")).drop("_part", "_norm")
    parts = links.where("_part").groupBy("depth", "bucket", "_h", "_norm").agg(
        F.first("_sha").alias("_sha"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    entries = whole.unionByName(parts.select(whole.columns))
    chain = Window.partitionBy("depth", "bucket", "_h").orderBy(F.col("keep_id").asc_nulls_last(), "_sha")
    entries = entries.withColumn("link", F.row_number().over(chain))
    path = new_dir(spark, "exact-index")
    entries.repartitionByRange("bucket", "depth", "_h").sortWithinPartitions("bucket", "depth", "_h", "link").write.parquet(path)
    return pointers, spark.read.schema(entries.schema).parquet(path), found(seek)


def exact_dedup(docs: DataFrame, capacity: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    _, entries, seek = _indexed(docs, _keys(docs), capacity)
    found = seek.join(entries.select("depth", "bucket", "_h", "_sha", "keep_id", "group_size"), ["depth", "bucket", "_h", "_sha"])
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
                        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256"))


def survivors(docs: DataFrame, capacity: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, one per group, with all their columns."""
    kept = exact_dedup(docs, capacity).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_s")).distinct()
    rows = wrapped(docs).select("row", "doc_id", F.sha2(normalised(text_of()), 256).alias("_sha"))
    stay = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_s")))
    # rows repeated under one id: one of them stays
    return stay.dropDuplicates(["_id", "_s"]).select("row.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
