"""Toxicity by multiple-instance learning: labels on documents, scores on sentences.

A sentence (maximal run without ``.``, ``!``, ``?`` or line end) has the probability
sigmoid(bias + sum over its distinct words of the word's weight); a word's weight is that of the
word itself plus those of its prefixes of ``PREFIXES`` bytes.  A document is toxic unless every
sentence is clean: 1 - product(1 - p), the noisy-or.  The weights are trained through the noisy-or
from document labels alone (proximal Adam with an L1 penalty); the same weights then locate the
offending sentences.

The fit reads a bounded sample of labelled rows (``FIT_ROWS``, ``sampling.MAX_BYTES``); scoring is
one pass over whole texts.  A task remembers the weights of at most ``CACHE`` words.

Defined cases: null and empty texts have no sentence and score 0; without a toxic and a clean
labelled row every score is 0; repeated rows score alike.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.llm.common import fold, text_of, words_of
from sitefold.llm.sampling import labelled_sample

PREFIXES = (5, 6, 7)
FIT_ROWS = 4_000
MIN_DOCS = 3
STEPS, RATE, L1 = 300, 0.1, 0.5
START_BIAS, MOST_BIAS = -7.0, -4.0
CACHE = 100_000
SENTENCE = re.compile(rb"[^.!?\n]+")


def features(word: bytes) -> list[bytes]:
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) > n)]


def sentences(raw: bytes) -> list[set[bytes]]:
    return [w for m in SENTENCE.finditer(raw) if (w := set(words_of(m[0])))]


def _expand(at: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each index in ``at`` its list values[offsets[i]:offsets[i + 1]]: (position in ``at``, value)."""
    n = offsets[at + 1] - offsets[at]
    place = np.repeat(np.arange(len(at)), n)
    return place, values[np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + offsets[at][place]]


def train(texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> tuple[dict[bytes, float], float]:
    """(feature weights, bias) of least noisy-or log loss plus the L1 penalty."""
    ids: dict[bytes, int] = {}
    token, owner, document = array("i"), array("i"), array("i")  # word and sentence of a token, document of a sentence
    for d, text in enumerate(texts):
        for words in sentences(text):
            token.extend(ids.setdefault(w, len(ids)) for w in words)
            owner.extend([len(document)] * len(words))
            document.append(d)
    token, owner, document = (np.array(a, np.int64) for a in (token, owner, document))
    if not len(document):
        return {}, START_BIAS
    pair = np.unique(document[owner] * len(ids) + token)
    often = np.bincount(pair % len(ids), minlength=len(ids)) >= MIN_DOCS
    names: dict[bytes, int] = {}
    offsets, values = [0], array("i")
    for w, keep in zip(ids, often.tolist(), strict=True):  # rare words count through their prefixes only
        values.extend(names.setdefault(f, len(names)) for f in features(w)[0 if keep else 1:])
        offsets.append(len(values))
    offsets, values = np.array(offsets), np.array(values, np.int64)
    # features that toxic documents hold at least twice as often as clean ones, and their first weights
    place, own = _expand(pair % len(ids), offsets, values)
    held = np.unique((pair // len(ids))[place] * len(names) + own)
    seen = np.bincount(held % len(names), minlength=len(names))
    toxic = np.bincount((held % len(names))[y[held // len(names)] == 1], minlength=len(names))
    n1, n0 = y.sum(), len(y) - y.sum()
    chosen = np.flatnonzero((seen >= MIN_DOCS) & (toxic / n1 > 2 * (seen - toxic) / n0))
    odds = np.log((toxic + 0.05) / (n1 + 1)) - np.log((seen - toxic + 0.05) / (n0 + 1))
    w, b = (np.maximum(0, odds) * np.minimum(1, toxic / 8))[chosen], START_BIAS
    rank = np.full(len(names), -1)
    rank[chosen] = np.arange(len(chosen))
    place, own = _expand(token, offsets, values)
    live = rank[own] >= 0
    feature, sentence = rank[own[live]], owner[place[live]]

    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(sentence, w[feature], minlength=len(document)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        clean = np.minimum(np.bincount(document, -np.logaddexp(0, z), minlength=len(y)), -1e-9)  # log P(no toxic sentence)
        slope = np.where(y == 1, np.exp(clean) / np.maximum(-np.expm1(clean), 1e-9), -1.0) * weight
        per_sentence = -p * np.clip(slope, -50, 50)[document]
        g = np.append(np.bincount(feature, per_sentence[sentence], minlength=len(w)) + L1 * np.sign(w), per_sentence.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        moved = w - move[:-1]
        w = np.where((np.sign(moved) != np.sign(w)) & (w != 0), 0.0, moved)  # a weight stops at zero
        b = min(b - move[-1], MOST_BIAS)
    spelt = list(names)
    return {spelt[f]: float(x) for f, x in zip(chosen, w, strict=True) if abs(x) > 1e-3}, float(b)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = FIT_ROWS) -> tuple[dict[bytes, float], float] | None:
    """The model from texts and (doc_id, label 0/1); None without both labels."""
    rows, counts = labelled_sample(docs, labels, max_rows)
    y = np.array([int(r["label"] == 1) for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    # equal shares of the labels in the sample; the weights restore their proportion, mean 1
    total = counts[0] + counts[1]
    weight = np.where(y == 1, counts[1] / total / y.mean(), counts[0] / total / (1 - y.mean()))
    return train([r["text"].encode() for r in rows], y, weight)


class Scorer:
    def __init__(self, model: tuple[dict[bytes, float], float]):
        self.weights, self.bias = model
        self.known: dict[bytes, float] = {}

    def word(self, w: bytes) -> float:
        got = self.known.get(w)
        if got is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            got = self.known[w] = sum(self.weights.get(f, 0.0) for f in features(w))
        return got

    def __call__(self, raw: bytes, threshold: float) -> tuple[float, list[int], list[int], list[float]]:
        """Score, and start, end (code points) and probability of the sentences over ``threshold``."""
        clean, spans, at, chars = 0.0, ([], [], []), 0, 0
        word = self.word
        for m in SENTENCE.finditer(raw):
            words = set(words_of(m[0]))
            if not words:
                continue
            z = self.bias + sum(map(word, words))
            clean -= np.logaddexp(0, z)
            p = 1 / (1 + np.exp(-max(z, -50.0)))
            if p >= threshold:
                chars += len(raw[at:m.start()].decode())
                at = m.start()
                for out, x in zip(spans, (chars, chars + len(m[0].decode()), float(p)), strict=True):
                    out.append(x)
        return float(-np.expm1(clean)), *spans


def score(docs: DataFrame, model: tuple[dict[bytes, float], float] | None, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` and the offending sentences: arrays ``starts``, ``ends``, ``scores``."""
    docs = docs.drop("score", "starts", "ends", "scores")
    schema = "score double, starts array<long>, ends array<long>, scores array<double>"
    if model is None:
        empty = F.array()
        return (docs.withColumn("score", F.lit(0.0)).withColumn("starts", empty.cast("array<long>"))
                .withColumn("ends", empty.cast("array<long>")).withColumn("scores", empty.cast("array<double>")))

    @F.pandas_udf(schema)
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for s in texts:
            yield pd.DataFrame([scorer(t, threshold) for t in s], columns=["score", "starts", "ends", "scores"])

    return docs.withColumn("_j", judge(text_of().cast("binary"))).select("*", "_j.*").drop("_j")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    scored = score(docs, fit(docs, labels.where(fold("doc_id", 5) != 0)))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("starts").alias("n_toxic_sentences"))
