"""Plan helpers.

Catalyst pushes a Filter below a Project by substituting the Project's expressions into the
condition.  For the long chains of staged string columns built here (URL parts -> resolved URL ->
normalized URL, or the HTML fold) that substitution inlines every stage into the condition and the
expression tree grows geometrically.  A Project that carries a non-deterministic column is not
crossed by that rule, so ``fenced_filter`` keeps the predicate where it is written.  The fence is
``spark_partition_id()``: free to compute and never removed while the filter refers to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FENCE = "_fence"


def fenced_filter(df: DataFrame, condition: Column) -> DataFrame:
    """``df.filter(condition)`` evaluated on the columns as computed, not re-inlined below."""
    return df.withColumn(_FENCE, F.spark_partition_id()).filter(condition & (F.col(_FENCE) >= 0)).drop(_FENCE)


def fence(df: DataFrame) -> DataFrame:
    """``df`` behind a projection that Catalyst doesn't merge with the next one, so that two long
    chains of expressions don't become one method too large to compile."""
    return df.withColumn(_FENCE, F.spark_partition_id()).filter(F.col(_FENCE) >= 0).drop(_FENCE)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the cluster's checkpoint folder and read it back (reliable, survives
    executor loss; cuts lineage).  For small derived tables that several branches of a plan read."""
    from sitefold.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def chunked_row_number(df: DataFrame, keys: list[str], order: str, out: str, chunk_width: int = 1 << 20) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` (1-based) computed without sorting
    a whole key in one task: numbers inside (keys, order chunk) plus the count of rows in the key's
    earlier chunks (a prefix sum over the small per-chunk summary).  ``order`` must be an integer
    column and unique within a key; ``out`` must not start with '_'."""
    from pyspark.sql import Window

    df = df.withColumn("_chunk", F.floor(F.col(order) / chunk_width))
    local = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(order)))
    counts = df.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    out_df = local.join(counts.select(*keys, "_chunk", "_off"), [*keys, "_chunk"])
    return out_df.withColumn(out, (F.col("_off") + F.col("_rn")).cast("long")).drop("_chunk", "_rn", "_off")


def chunked_running_sum(df: DataFrame, keys: list[str], order: str, value: str, out: str,
                        chunk_width: int = 1 << 20, inclusive: bool = True) -> DataFrame:
    """Running ``sum(value)`` per key in ``order`` (exclusive of the current row when
    ``inclusive`` is False), computed per (key, order chunk) plus the totals of the key's earlier
    chunks, so a huge key is summed in parallel.  ``order`` is an integer column, unique per key."""
    from pyspark.sql import Window

    df = df.withColumn("_chunk", F.floor(F.col(order) / chunk_width))
    frame_end = Window.currentRow if inclusive else -1
    w = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, frame_end)
    local = df.withColumn("_loc", F.coalesce(F.sum(value).over(w), F.lit(0)))
    totals = df.groupBy(*keys, "_chunk").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_tot"))
    wc = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_off", F.coalesce(F.sum("_tot").over(wc), F.lit(0)))
    joined = local.join(totals.select(*keys, "_chunk", "_off"), [*keys, "_chunk"])
    return joined.withColumn(out, (F.col("_off") + F.col("_loc")).cast("long")).drop("_chunk", "_loc", "_off")


def range_numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with ``out`` = 0, 1, ... in ``order`` over all rows: range partitions, materialized, each
    numbered by its task; the counts of the tasks (one row each, which bounds the broadcast) are
    summed up before it.  Columns starting with '_n' are used inside."""
    from pyspark.sql import Window

    laid = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_nat", F.monotonically_increasing_id()))
    laid = laid.withColumn("_npart", F.shiftright("_nat", 33))
    before = Window.orderBy("_npart").rowsBetween(Window.unboundedPreceding, -1)
    parts = laid.groupBy("_npart").agg(F.count(F.lit(1)).alias("_nrows"), F.min("_nat").alias("_nfirst"))
    parts = parts.select("_npart", "_nfirst", F.coalesce(F.sum("_nrows").over(before), F.lit(0)).alias("_nbefore"))
    rank = (F.col("_nat") - F.col("_nfirst") + F.col("_nbefore")).cast("long")
    return laid.join(F.broadcast(parts), "_npart").withColumn(out, rank).drop("_nat", "_npart", "_nfirst", "_nbefore")
