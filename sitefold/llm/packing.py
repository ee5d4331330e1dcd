"""Sequence packing: shortest pack first over the length histogram.

1. Every whole text is tokenised once; a document longer than a sequence is cut into full sequences
   and one rest.  Only piece descriptions are kept (no ids): start, length, CRC of the ids.
2. The histogram of piece lengths has at most ``size`` rows, whatever the corpus; the driver packs
   it: lengths longest first, each into the open packs with the fewest tokens that still have room,
   a whole group of equal packs at a time, so the work follows the number of lengths.
3. Pieces of one length are ranked 0, 1, 2, ...; the ranks of a length are cut into slots, and a
   slot maps its ranks to consecutive sequence ids.  Ranks are counted per (length, hash bucket)
   and shifted by the counts of the earlier buckets, so a length that a third of all pieces share
   is ranked by many tasks.

Defined cases: a null or empty text is the end token alone; repeated rows are packed like any
others; equal lengths are ranked by (id, start, CRC); an empty table gives no sequence.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitefold.llm.common import map_rows, stored, text_of

SIZE = 2048
END_ID = 1
SPECIAL = {"<|endoftext|>": 50256}  # fixed value of the vocabulary
PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def encoder(ranks_path: str) -> Callable[[str], list[int]]:
    """The ids of a text under the byte-level BPE of the 50k vocabulary, as ``tokenizers`` gives them
    (add_special_tokens=False).  tiktoken reads the same vocabulary as ranks and is five times as
    fast, but gives up on very long runs of white space; such a text goes to ``tokenizers``."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    slow = []

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except ValueError:  # its regular expression ran out of stack
            if not slow:
                import tokenizers

                slow.append(tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
            return slow[0].encode(text, add_special_tokens=False).ids

    return encode


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(docs: DataFrame, size: int = SIZE, ranks_path: str | None = None) -> DataFrame:
    """One row per piece of every document (doc_id and ``PIECES``)."""

    def make():
        encode = encoder(ranks_path or default_ranks())

        def work(cols: dict) -> Iterator[tuple]:
            for doc_id, text in zip(cols["doc_id"], cols["text"], strict=True):
                ids = np.append(np.array(encode(text), dtype="<u4"), np.uint32(END_ID))
                for start in range(0, len(ids), size):
                    part = ids[start:start + size]
                    yield doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)

        return work

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", text_of().alias("text")), make, f"doc_id {id_type}, {PIECES}")


def pack_histogram(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, count, first sequence, offset): the ``count`` pieces of ``length``
    from ``first rank`` on go to that many sequences from ``first sequence`` on, at ``offset``."""
    slots: list[tuple[int, int, int, int, int]] = []
    by_fill: dict[int, list[tuple[int, int]]] = defaultdict(list)  # tokens -> runs (first sequence, count)
    fills = np.zeros(size + 1, dtype=np.int64)  # number of open packs by tokens
    made = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = np.flatnonzero(fills[: size - length + 1])
            if not len(room):
                run = (made, left)
                made += left
                fill = 0
            else:
                fill = int(room[0])
                first, n = by_fill[fill].pop()
                run = (first, min(n, left))
                if n > left:
                    by_fill[fill].append((first + left, n - left))
                fills[fill] -= run[1]
            slots.append((length, rank, run[1], run[0], fill))
            by_fill[fill + length].append(run)
            fills[fill + length] += run[1]
            rank += run[1]
            left -= run[1]
    return slots


def pack(docs: DataFrame, size: int = SIZE, ranks_path: str | None = None) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, size, ranks_path), "packing-pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = pack_histogram(counts, size)
    table = {}
    for length in counts:
        own = [s for s in slots if s[0] == length]
        table[length] = tuple(np.array([s[i] for s in own], dtype=np.int64) for i in (1, 3, 4))

    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("_rank", F.row_number().over(order) - 1)
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = (cut.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n"))
             .select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shift")))
    ranked = ranked.join(shift, ["length", "_bucket"]).withColumn("_rank", (F.col("_rank") + F.col("_shift")).cast("long"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        values, at = np.unique(length.to_numpy(), return_inverse=True)
        for i, value in enumerate(values):
            mine = np.flatnonzero(at == i)
            first, seq, off = table[int(value)]
            r = rank.to_numpy()[mine]
            k = np.searchsorted(first, r, side="right") - 1
            sequence[mine], offset[mine] = seq[k] + r - first[k], off[k]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("_at", place("length", "_rank"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "_at.sequence_id", "_at.offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
