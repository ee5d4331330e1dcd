"""Sharding by histogram sort (DataFrame functions only).

Rows are sorted by a key and cut into shards of near equal bytes:

1. *Probes.*  The key is a tuple of longs.  Candidate boundaries lie evenly between the least and
   the greatest key of each open stretch of the key order; one pass counts the exact bytes between
   neighbouring probes, with partial aggregation in every partition.  The driver sees at most
   ``PROBES`` counts for each splitter sought, whatever the corpus.
2. *Refinement.*  A splitter is settled once a probe lies within ``tolerance`` of its target; else
   the next pass puts all probes between its two neighbours.  Where all keys of a stretch agree in
   one component, the next component goes on, so a text that a third of all rows share is cut like
   any other.  A pass reads keys and sizes only, from the shared folder.
3. *Exchange.*  With the splitters known, whole rows cross the network once, range partitioned by
   (shard, key), and each task writes its stretch in order.  Slots follow from the counts of the
   tasks, so a shard may be written by many of them.

The default tolerance is 0: a row goes to shard ``floor(shards * before / total)`` with the bytes
``before`` it, so shards differ by one row at most, and the result doesn't depend on the probes.

Defined cases: null text = empty text, of one byte like any text's end; equal texts lie next to
each other, ordered by id, null first; rows repeated under one id are placed like any others (the
order among them is that of the scan); fewer rows than shards leave shards empty.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitefold.llm.common import SQL_CRC, new_dir, sql_crc32, stored, text_of

SHARDS = 16
PROBES = 1024


@dataclass(frozen=True)
class Stretch:
    """Keys that start with ``prefix`` and go on within ``lo`` .. ``hi``; ``before``: the weight of
    all smaller keys; ``targets``: the splitters sought inside."""

    prefix: tuple[int, ...]
    lo: int
    hi: int
    before: int
    targets: tuple[int, ...]

    @property
    def shift(self) -> int:
        s = 0
        while (self.hi >> s) - (self.lo >> s) >= PROBES:
            s += 1
        return s


def _counts(keyed: DataFrame, keys: list[str], weight: str, open_: list[Stretch]) -> dict[int, list]:
    """Per open stretch the weights between its probes, in order."""
    def pick(value) -> Column:
        out = F.lit(None)
        for i, s in reversed(list(enumerate(open_))):
            here = F.col(keys[len(s.prefix)]).between(s.lo, s.hi)
            for k, v in zip(keys, s.prefix, strict=False):
                here = here & (F.col(k) == v)
            out = F.when(here, value(i, s)).otherwise(out)
        return out.cast("long")

    def following(i: int, s: Stretch) -> Column:
        return F.col(keys[min(len(s.prefix) + 1, len(keys) - 1)])

    cells = keyed.select(
        pick(lambda i, s: F.lit(i)).alias("stretch"), pick(lambda i, s: F.shiftright(keys[len(s.prefix)], s.shift)).alias("probe"),
        pick(lambda i, s: F.col(keys[len(s.prefix)])).alias("v"), pick(following).alias("f"), F.col(weight).alias("w"))
    found = cells.where("stretch is not null").groupBy("stretch", "probe").agg(
        F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.min("f").alias("next_lo"), F.max("f").alias("next_hi")).collect()
    out: dict[int, list] = {}
    for r in sorted(found, key=lambda r: (r["stretch"], r["probe"])):
        out.setdefault(r["stretch"], []).append(r)
    return out


def splitters(keyed: DataFrame, keys: list[str], weight: str, shards: int, tolerance: float = 0.0) -> list[tuple[int, ...]]:
    """The least keys of shards 1, 2, ...: tuples over ``keys`` (non-null longs, compared as far as
    a tuple goes) such that the ``weight`` below splitter i misses i/shards of the total by at most
    ``tolerance`` of a shard, or by one row."""
    first = keyed.agg(F.sum(weight).alias("w"), F.min(keys[0]).alias("lo"), F.max(keys[0]).alias("hi")).first()
    if first["w"] is None:
        return []
    total, slack = first["w"], tolerance * first["w"]
    cuts: dict[int, tuple[int, ...]] = {}
    open_ = [Stretch((), first["lo"], first["hi"], 0, tuple(range(1, shards)))] if shards > 1 else []
    while open_:
        counts, deeper = _counts(keyed, keys, weight, open_), []
        for i, s in enumerate(open_):
            below = s.before
            for r in counts[i]:
                above, inside = below + r["w"], []
                for t in s.targets:
                    if not shards * below < t * total <= shards * above:
                        continue
                    if t * total - shards * below <= slack:
                        cuts[t] = (*s.prefix, r["lo"])
                    elif shards * above - t * total <= slack or r["n"] == 1 or (r["lo"] == r["hi"] and len(s.prefix) + 1 == len(keys)):
                        cuts[t] = (*s.prefix, r["hi"] + 1)
                    else:
                        inside.append(t)
                if inside and r["lo"] < r["hi"]:
                    deeper.append(Stretch(s.prefix, r["lo"], r["hi"], below, tuple(inside)))
                elif inside:
                    deeper.append(Stretch((*s.prefix, r["lo"]), r["next_lo"], r["next_hi"], below, tuple(inside)))
                below = above
        open_ = deeper
    return [cuts[t] for t in range(1, shards)]


def _at_least(keys: list[str], cut: tuple[int, ...]) -> Column:
    *head, last = zip(keys, cut, strict=False)
    return reduce(lambda rest, kv: (F.col(kv[0]) > kv[1]) | ((F.col(kv[0]) == kv[1]) & rest), reversed(head), F.col(last[0]) >= last[1])


def shard_of(keys: list[str], cuts: list[tuple[int, ...]], lo: int = 0, hi: int | None = None) -> Column:
    """The number of splitters at or below a row's key, as a binary search of nested conditions."""
    hi = len(cuts) if hi is None else hi
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(_at_least(keys, cuts[mid]), shard_of(keys, cuts, mid + 1, hi)).otherwise(shard_of(keys, cuts, lo, mid))


KEYS = ["_text", "_has_id", "_id", "_row"]


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, _size, key): the first 60 bits of the text's SHA-256, the id, the row's place in the scan."""
    number = docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)) if number else F.xxhash64("doc_id")
    return docs.select(
        F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"), (F.octet_length(text_of()) + 1).cast("long").alias("_size"),
        F.conv(F.substring(F.sha2(text_of(), 256), 1, 15), 16, 10).cast("long").alias("_text"),
        F.col("doc_id").isNotNull().cast("long").alias("_has_id"), ident.cast("long").alias("_id"),
        F.monotonically_increasing_id().alias("_row"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, tolerance: float = 0.0) -> DataFrame:
    """``docs`` as parquet files under ``path``/shard=<n>, each shard in key order, read back as
    (row, shard, slot); ``row`` holds all columns of ``docs``."""
    spark, keyed = docs.sparkSession, _keyed(docs)
    cuts = splitters(stored(keyed.select("_size", *KEYS), "shard-keys"), KEYS, "_size", shards, tolerance)
    order = ["shard", *KEYS]
    dealt = (keyed.withColumn("shard", shard_of(KEYS, cuts).cast("int")).repartitionByRange(*order).sortWithinPartitions(*order)
             .select("row", F.monotonically_increasing_id().alias("_at"), "shard"))
    dealt.write.partitionBy("shard").parquet(path)
    files = spark.read.schema(dealt.schema).parquet(path).withColumn("_part", F.shiftright("_at", 33))
    # one row for each task and shard it wrote: tasks + shards at most
    parts = files.groupBy("shard", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("shard", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = files.join(F.broadcast(parts), ["shard", "_part"])
    return placed.select("row", "shard", (F.col("_at") - F.col("_first") + F.col("_before")).cast("long").alias("slot"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce("row.text", F.lit(""))
    return write_shards(docs, new_dir(spark, "shards")).select(
        "row.doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP12_SQL = f"""
WITH {SQL_CRC}, d AS (
  SELECT doc_id, coalesce(text, '') AS t, ('0x' || substr(sha256(coalesce(text, '')), 1, 15))::BIGINT AS k FROM documents
), s AS (SELECT *, (strlen(t) + 1)::BIGINT AS size FROM d),
b AS (SELECT *, coalesce(sum(size) OVER (ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(size) OVER () AS total FROM s),
p AS (SELECT *, (({SHARDS} * before) // total)::INTEGER AS shard FROM b)
SELECT doc_id, size, {sql_crc32('t')}::BIGINT AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY k, doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM p, crc
"""
