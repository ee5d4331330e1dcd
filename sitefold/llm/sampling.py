"""Bounded samples of labelled rows, for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from sitefold.llm.common import text_of

#: A fit reads at most so many rows and so many bytes of text.
MAX_ROWS = 8_000
#: More labels than that: the commonest are learned (ties: the smaller label).
MAX_LABELS = 500
MAX_BYTES = 64 << 20
#: Texts over this share of the bytes come last, except the shortest of a label that has no other.
TEXT_SHARE = 1 / 16


def _fitting(sizes: list[tuple], max_bytes: int) -> list[int]:
    """Positions of the texts, given as (label, bytes) in order of preference, that are taken: each
    that fits what is left; long ones last, except the shortest of a label that has no other."""
    shortest: dict = {}
    for i, (label, size) in enumerate(sizes):
        if label not in shortest or size < sizes[shortest[label]][1]:
            shortest[label] = i
    limit = max_bytes * TEXT_SHARE
    first = sorted((i for i in shortest.values() if sizes[i][1] > limit), key=lambda i: sizes[i][1])
    chosen, left = [], max_bytes
    rest = sorted(set(range(len(sizes))).difference(first), key=lambda i: (sizes[i][1] > limit, i))
    for i in [*first, *rest]:
        if sizes[i][1] <= left:
            chosen.append(i)
            left -= sizes[i][1]
    return chosen


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> tuple[list, dict]:
    """Rows (doc_id, label, text) of a sample with equal shares of every label, and the number of
    rows of each label.  ``labels`` is (doc_id, label); rows without either are left out.  Within a
    label the ids of smallest hash are taken.  The bound on bytes is applied to their lengths: a text
    that doesn't fit is skipped, not those after it, and only texts that fit are read."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).select("doc_id", "label").distinct()
    common = known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(min(MAX_LABELS, max_rows))
    counts = {r["label"]: r["n"] for r in common.collect()}
    if not counts:
        return [], {}
    share = max(1, max_rows // len(counts))
    # a hash threshold leaves about twice a label's share; the window then cuts to the share exactly
    cut = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1.0, 2 * share / n + 64 / n) * (1 << 30))))])
    near = known.where(F.col("label").isin(list(counts))).withColumn("_h", F.xxhash64("doc_id", F.lit(17))).where(F.pmod("_h", F.lit(1 << 30)) < cut[F.col("label")])
    first = Window.partitionBy("label").orderBy(F.pmod("_h", F.lit(1 << 30)), "_h", "doc_id")
    ids = near.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= share).select("doc_id", "label", "_r")
    # at most max_rows ids: the bound of this broadcast
    def texts_of(ids: DataFrame) -> DataFrame:
        texts = docs.select(F.col("doc_id").alias("_id"), text_of().alias("text")).join(F.broadcast(ids), F.col("_id") == F.col("doc_id"))
        return texts.drop("_id").withColumns({"_b": F.octet_length("text"), "_t": F.xxhash64("text")})

    # lengths first; repeated rows count once, and an id with several texts has its shortest
    sizes = texts_of(ids).groupBy("doc_id", "label", "_r").agg(F.min(F.struct("_b", "_t")).alias("s"))
    sizes = sizes.select("doc_id", "label", "_r", "s.*").orderBy("_r", "label", "doc_id").collect()
    chosen = _fitting([(r["label"], r["_b"]) for r in sizes], max_bytes)
    if not chosen:
        return [], counts
    wanted = docs.sparkSession.createDataFrame([(sizes[i]["doc_id"], sizes[i]["label"], sizes[i]["_b"], sizes[i]["_t"]) for i in chosen],
                                               ids.select("doc_id", "label").schema.add("_wb", IntegerType()).add("_wt", LongType()))
    rows = texts_of(wanted).where("_b = _wb and _t = _wt").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return rows.select("doc_id", "label", "text").orderBy("doc_id", "label").collect(), counts
