import random
import zlib

import pytest
from pyspark.sql import functions as F

from sitefold.llm import sharding
from tests.llm.cases import edge_rows, frame, prose, random_rows


def cases():
    rng = random.Random(4)
    copies = [(i, prose(7, 60)) for i in range(150)] + [(1000, "same row")] * 80
    return {"edges": edge_rows(), "random": random_rows(6, 300), "copies": copies + random_rows(8, 150), "few": [(5, "a"), (6, None)],
            "long": [(i, "x" * rng.choice([0, 1, 10, 100_000])) for i in range(100)]}


@pytest.mark.parametrize("name", ["edges", "random", "copies", "few", "long"])
def test_bytes_and_slots(spark, tmp_path, name):
    rows = cases()[name]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.op12_sharding(spark, str(tmp_path)).collect()
    raw = [(i, (t or "").encode()) for i, t in rows]
    assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in out if r["doc_id"] is not None) == sorted(
        (i, len(t) + 1, zlib.crc32(t), "bytes", None) for i, t in raw if i is not None)
    assert len(out) == len(rows)
    shards = {}
    for r in sorted(out, key=lambda r: (r["shard"], r["slot"])):
        shards.setdefault(r["shard"], []).append(r)
    total, before = sum(len(t) + 1 for _, t in raw), 0
    for s in sorted(shards):
        assert [r["slot"] for r in shards[s]] == list(range(len(shards[s])))
        for r in shards[s]:
            assert s == sharding.SHARDS * before // total
            before += r["size"]


def test_whole_rows_and_files(spark, tmp_path):
    docs = frame(spark, random_rows(9, 80))
    out = sharding.write_shards(docs, f"{tmp_path}/shards", shards=5)
    assert sorted(map(str, out.select("row.*").collect())) == sorted(map(str, docs.collect()))
    assert sorted(p.name for p in tmp_path.glob("shards/shard=*")) == [f"shard={i}" for i in range(5)]
    texts = [r["text"] or "" for r in out.orderBy("shard", "slot").select("row.text").collect()]
    assert len(set(texts)) == 1 + sum(a != b for a, b in zip(texts, texts[1:], strict=False))  # equal texts lie together


@pytest.mark.parametrize("tolerance", [0.0, 0.2])
def test_splitters_of_skewed_keys(spark, tolerance):
    """Keys over the whole range of longs, a third of them equal; every splitter meets its target."""
    rng = random.Random(5)
    first = [rng.choice([-(1 << 63), (1 << 63) - 2, rng.randrange(-1 << 62, 1 << 62), 17, 17]) for _ in range(3000)]
    rows = [(k, rng.randrange(-5, 5), i, rng.choice([1, 2, 900])) for i, k in enumerate(first)]
    keyed = spark.createDataFrame(rows, "a long, b long, c long, w long")
    cuts = sharding.splitters(keyed, ["a", "b", "c"], "w", 7, tolerance)
    total, got = sum(r[3] for r in rows), []
    for t, cut in enumerate(cuts, 1):
        below = sorted(r for r in rows if r[:len(cut)] < cut)
        w = sum(r[3] for r in below)
        got.append(len(below))
        assert abs(7 * w - t * total) <= tolerance * total or (7 * (w - below[-1][3]) < t * total <= 7 * w)
    counted = keyed.groupBy(sharding.shard_of(["a", "b", "c"], cuts).alias("s")).count().orderBy("s").collect()
    assert [r["count"] for r in counted] == [b - a for a, b in zip([0, *got], [*got, 3000], strict=True)]


def test_empty_table(spark, tmp_path):
    assert sharding.write_shards(frame(spark, []), f"{tmp_path}/none").collect() == []
    assert sharding.splitters(spark.range(0).select("id", F.lit(1).alias("w")), ["id"], "w", 4) == []
