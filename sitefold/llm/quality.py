"""Quality by compression: two zstandard dictionaries, one built from good and one from bad text.

A text is cut into chunks of ``CHUNK`` bytes and every chunk compressed under both dictionaries: the
dictionary that knows the kind of text wins.  The normalised difference of the compressed sizes,
with the plain compression ratios (repetition), is calibrated into a probability by a logistic
regression on labelled rows that built neither dictionary.

Dictionaries and calibration are fitted on a bounded sample of labelled rows
(``sampling.MAX_ROWS`` rows, ``MAX_BYTES`` bytes); scoring is one pass over whole texts.

Defined cases: a null text is empty, and empty texts get the score of their features like any
other; without labelled rows of both kinds every score is 0.5; repeated rows score alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.llm.common import fold, text_of
from sitefold.llm.sampling import MAX_ROWS, labelled_sample

CHUNK = 1024
DICTIONARY_BYTES = 1 << 16
LEVEL = 3
RIDGE = 1.0


def _chunks(raw: bytes) -> list[bytes]:
    return [raw[i:i + CHUNK] for i in range(0, len(raw), CHUNK)] or [b""]


def train_dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; the raw end of the samples where they are too few to train on."""
    samples = [c for t in texts for c in _chunks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


class Features:
    """Compressed sizes of a text under both dictionaries, normalised by its length."""

    def __init__(self, good: bytes, bad: bytes):
        def compressor(raw: bytes) -> zstandard.ZstdCompressor:
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.good, self.bad, self.plain = compressor(good), compressor(bad), zstandard.ZstdCompressor(level=LEVEL)

    def __call__(self, text: str) -> list[float]:
        raw = text.encode()
        parts = _chunks(raw)
        good = np.array([len(self.good.compress(p)) for p in parts])
        bad = np.array([len(self.bad.compress(p)) for p in parts])
        length = np.array([len(p) + 1 for p in parts])
        each = (good - bad) / np.minimum(good, bad)
        g, b, n = int(good.sum()), int(bad.sum()), len(raw) + 1
        return [(g - b) / min(g, b), each.max(), each.min(), min(g, b) / n, len(self.plain.compress(raw)) / n, np.log(n), (good / length).min()]


def _design(x: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """Standardised features with their products."""
    z = np.clip((x - mean) / deviation, -4, 4)
    products = [z[:, i] * z[:, j] for i in range(z.shape[1]) for j in range(i, z.shape[1])]
    return np.column_stack([np.ones(len(z)), z, *products])


def _logistic(a: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = weight * (p * (1 - p) + 1e-6)
        w -= np.linalg.solve(a.T @ (a * h[:, None]) + RIDGE * np.eye(len(w)), a.T @ (weight * (p - y)) + RIDGE * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple | None:
    """(good, bad, mean, deviation, weights) from texts and (doc_id, label 0/1)."""
    rows, counts = labelled_sample(docs, labels, max_rows)
    builds = [zlib.crc32(b"d%s" % str(r["doc_id"]).encode()) % 2 == 0 for r in rows]
    kinds = [[r["text"].encode() for r, b in zip(rows, builds, strict=True) if b and r["label"] == k] for k in (1, 0)]
    rest = [r for r, b in zip(rows, builds, strict=True) if not b]
    y = np.array([float(r["label"] == 1) for r in rest])
    if not all(any(k) for k in kinds) or len(set(y)) < 2:
        return None
    good, bad = map(train_dictionary, kinds)
    features = Features(good, bad)
    x = np.array([features(r["text"]) for r in rest])
    mean, deviation = x.mean(0), x.std(0) + 1e-9
    # the sample holds equal shares of the labels; the weights restore their proportion
    total = sum(counts.get(k, 0) for k in (0, 1))
    weight = np.where(y == 1, counts[1] / total / y.mean(), counts[0] / total / (1 - y.mean()))
    return good, bad, mean, deviation, _logistic(_design(x, mean, deviation), y, weight)


def score(docs: DataFrame, model: tuple | None) -> DataFrame:
    """``docs`` with a column ``score``: the probability that the text is good."""
    if model is None:
        return docs.withColumn("score", F.lit(0.5))
    good, bad, mean, deviation, weights = model

    @F.pandas_udf("double")
    def probability(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = Features(good, bad)
        for s in texts:
            x = np.array([features(t) for t in s]).reshape(len(s), -1)
            yield pd.Series(1 / (1 + np.exp(-np.clip(_design(x, mean, deviation) @ weights, -30, 30))))

    return docs.withColumn("score", probability(text_of()))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = fit(docs, labels.where(fold("doc_id", 4) != 2))
    scored = score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
