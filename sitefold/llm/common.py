"""Shared helpers of the training-data operators.

Conventions of every operator here: a null text counts as empty; a null id is an id like any other
(joins are null-safe); repeated rows give repeated result rows; columns other than the named ones
are ignored, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, as the contracts write it: [\x20\x09-\x0D].
WHITE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Only a ``local``
    session without that setting gets a scratch folder of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="sitefold-shared-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as parquet to the shared folder and read back: cuts the lineage with a
    copy that outlives any executor."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SEPARATORS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
                    for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """A-Z lower-cased, then maximal runs of 0-9, a-z and non-ASCII characters of a UTF-8 text."""
    return raw.translate(_SEPARATORS).split()


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fold(name: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id is the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def numbered(df: DataFrame, order: list, out: str, name: str) -> DataFrame:
    """``df`` on shared files, with ``out`` = 0, 1, ... in ``order`` and ``_part``, the task that
    wrote the row.  One range exchange; a task numbers its own rows, and the counts of the tasks
    (one row each, which is also the bound of the broadcast) are summed up before it."""
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    laid = stored(laid, name).withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_part_first"))
    parts = parts.select("_part", "_part_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_part_before"))
    rank = (F.col("_at") - F.col("_part_first") + F.col("_part_before")).cast("long")
    return laid.join(F.broadcast(parts), "_part").withColumn(out, rank).drop("_at", "_part_first", "_part_before")


def wrapped(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): whole rows as one column, so no added column clashes with theirs;
    ``select("row.*")`` brings them back."""
    return docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"), "doc_id", "text")


def _values(column: pa.Array, step: int = 512) -> Iterator:
    """The values of a column, as Python objects a few at a time."""
    for i in range(0, len(column), step):
        yield from column.slice(i, step).to_pylist()


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], Iterable[tuple] | None]], schema: str,
             batch: int = 2048) -> DataFrame:
    """``mapInArrow`` for per-document work: ``make()`` runs once per task and returns a function
    from a record batch's columns (name -> values, to be iterated once) to an iterable of result
    tuples.  Results leave in batches of at most ``batch`` rows, so a task holds one input and one
    output batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    names = df.columns
    spark_schema = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(spark_schema)
        work = make()

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        out: list[tuple] = []
        for b in batches:
            for row in work({n: _values(b.column(i)) for i, n in enumerate(names)}):
                out.append(row)
                if len(out) >= batch:
                    yield flush(out)
                    out = []
        if out:
            yield flush(out)

    return df.mapInArrow(run, spark_schema)


#: Polynomial hashes of words: sum of (byte + 1) * BASE^i over the bytes of a word, modulo 2^64.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(1 << 16, 2 * n), base, np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have, dtype=np.uint64)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def word_spans(raw: bytes, segment: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, ends, 64-bit hashes) of the white-space separated words of a text, a segment of its
    bytes at a time.  A word that passes the end of a segment comes with the segment it ends in."""
    open_at, open_hash = -1, 0  # the word that the last segment cut
    for lo in range(0, len(raw), segment):
        part = np.frombuffer(raw, np.uint8, min(segment, len(raw) - lo), lo)
        ink = ~_WHITE[part]
        edge = np.flatnonzero(np.diff(ink, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(part)), out=total[1:])
        h = (total[ends] - total[starts]) * powers(_INVERSE, len(part))[starts]
        starts, ends = starts + lo, ends + lo
        if open_at >= 0:
            if len(starts) and starts[0] == lo:
                h[0] = np.uint64((open_hash + pow(BASE, lo - open_at, 1 << 64) * int(h[0])) & 0xFFFFFFFFFFFFFFFF)
                starts[0] = open_at
            else:
                starts, ends = np.insert(starts, 0, open_at), np.insert(ends, 0, lo)
                h = np.insert(h, 0, np.uint64(open_hash))
            open_at = -1
        if len(ends) and ends[-1] == lo + len(part) and ends[-1] < len(raw):
            open_at, open_hash = int(starts[-1]), int(h[-1])
            starts, ends, h = starts[:-1], ends[:-1], h[:-1]
        if len(starts):
            yield starts, ends, mixed(h)


def sql_crc32(text: str) -> str:
    """DuckDB expression for the unsigned CRC-32 of a text's UTF-8 bytes; needs the table ``crc``
    of ``SQL_CRC`` in scope."""
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'), "
            f"lambda b: ('0x' || b)::BIGINT)), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])))")


SQL_CRC = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"""
