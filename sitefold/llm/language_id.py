"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

* Features: character n-grams (1 to 3) of the lower-cased text, hashed into ``2**BITS`` slots.  A
  slot's value is its relative frequency in the text times its inverse document frequency.
* Document frequencies are counted over all training documents, in one Spark pass.
* The weights are fitted on a bounded sample (``FIT_ROWS`` rows, ``sampling.MAX_BYTES`` bytes) by
  follow-the-regularised-leader with an elastic net: the L1 part keeps them sparse.
* A share of the sample is left out of the fit and sets the temperature of the softmax.
* Prediction is one pass over whole texts, a segment at a time; the model in a task has ``2**BITS``
  rows.
* *Strangeness.*  A score says which of the learned languages is likeliest, not whether it is one of
  them.  So the likelihood per n-gram, under all of them in equal parts (a text may change its
  language), is compared with that of the predicted language's held-out texts, in units of the spread that texts of that length have: a variance of
  texts plus one of n-grams over their number, so the evidence grows with the length.  Only words
  of letters count for it, each once: numbers, codes and marks are no language, repeats no evidence.
  ``recognised`` rejects texts that are ``STRANGE`` units off.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any labelled
row every text is ``und``; ties go to the smaller label; repeated rows are predicted alike; of more
labels than ``sampling.MAX_LABELS`` the commonest are learned; texts of under ``LEAST_NGRAMS``
n-grams and models without enough held-out texts have strangeness 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.llm.common import fold, map_rows, wrapped
from sitefold.llm.sampling import labelled_sample

FIT_ROWS = 4_000
BITS = 15
ORDERS = 3
SCALE = 30.0
#: FTRL: learning rate, its offset, L1 and L2; passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.02, 0.02, 3
#: A text is measured from so many n-grams on; held-out texts that its measure needs; units that are too many.
LEAST_NGRAMS, LEAST_HELD, STRANGE = 60, 30, 12.0
SEGMENT = 1 << 16
WORD = re.compile(r"[^\W_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def slots(text: str, starts: int | None = None) -> np.ndarray:
    """Hashed n-grams of a text, one entry per occurrence; with ``starts`` those that start in its
    first so many characters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    out, h = [], c
    for n in range(1, ORDERS + 1):
        if n > 1:
            if len(c) < n:
                break
            h = h[:-1] * _STEP + c[n - 1:]
        g = h[:starts]
        out.append((((g ^ (g >> np.uint64(29))) * _MULTIPLIER + np.uint64(n)) * _MULTIPLIER >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def counts(text: str) -> np.ndarray:
    """Number of n-grams in each slot, a segment of the text at a time."""
    low, out = text.lower(), np.zeros(1 << BITS, np.int64)
    for i in range(0, len(low), SEGMENT):
        out += np.bincount(slots(low[i:i + SEGMENT + ORDERS - 1], SEGMENT), minlength=1 << BITS)
    return out


def words_only(text: str) -> str:
    """The distinct words of a text that are letters throughout, collected by segments."""
    out: dict[str, None] = {}
    at = 0
    while at < len(text):
        end = at + SEGMENT
        if end < len(text):  # not within a word, unless it is longer than a segment
            end = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end)) + 1 or end
        out.update((w, None) for w in WORD.findall(text, at, end) if w.isalpha())
        at = end
    return " ".join(out)


class Model(NamedTuple):
    """Labels, weights (IDF and scale folded in) and temperature; log-likelihood of every slot, its
    mean per n-gram on each label's held-out texts and their variances (None: not enough)."""

    labels: list[str]
    weights: np.ndarray
    temperature: float
    likelihood: np.ndarray | None = None
    expected: np.ndarray | None = None
    spread: tuple[float, float] | None = None

    def strangeness(self, n: np.ndarray, label: int) -> float:
        """How far a text's likelihood is below that of the label's texts, given the counts of n-grams in its words."""
        total = int(n.sum())
        if self.spread is None or total < LEAST_NGRAMS:
            return 0.0
        miss = self.expected[label] - float(n @ self.likelihood) / total
        return max(0.0, miss / float(np.sqrt(self.spread[0] + self.spread[1] / total)))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Per slot the number of documents that hold it, and the number of documents."""

    def make():
        def work(cols: dict) -> Iterator[tuple]:
            df, n = np.zeros(1 << BITS, np.int64), 0
            for text in cols["text"]:
                if text:
                    df += counts(text) > 0
                    n += 1
            yield -1, n
            for s in np.flatnonzero(df):
                yield int(s), int(df[s])

        return work

    rows = map_rows(docs.select("text"), make, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(1 << BITS, np.int64), 0
    for r in rows:
        if r["slot"] < 0:
            total = r["n"]
        else:
            out[r["slot"]] = r["n"]
    return out, total


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Per-coordinate FTRL-proximal for a softmax over ``k`` classes."""

    def __init__(self, k: int):
        self.z = np.zeros((1 << BITS, k))
        self.n = np.zeros((1 << BITS, k))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = _softmax(x @ w)
        p[label] -= 1
        g = np.outer(x, p)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm.  Targets are
    smoothed by one row's worth, so that a faultless sample doesn't claim certainty."""
    right = np.arange(len(y))
    eps = 1 / (len(y) + 2)

    def loss(t: float) -> float:
        p = np.maximum(_softmax(logits / np.exp(t)), 1e-300)
        return -((1 - eps) * np.log(p[right, y]) + eps * np.log(p).mean(axis=1)).mean()

    a, b, r = -4.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _likelihoods(learned: list[tuple], held: list[tuple], k: int) -> tuple:
    """The last three fields of a ``Model`` from (slots, counts, label) of texts."""
    n = np.full((1 << BITS, k), 0.5)
    for at, c, y in learned:
        n[at, y] += c
    table = np.log((n / n.sum(axis=0)).mean(axis=1)).astype(np.float32)
    size = np.array([c.sum() for _, c, _ in held], float)
    value = np.array([c @ table[at] for at, c, _ in held]) / np.maximum(size, 1)
    label = np.array([y for _, _, y in held], int)
    some = size >= LEAST_NGRAMS
    if some.sum() < LEAST_HELD:
        return None, None, None
    size, value, label = size[some], value[some], label[some]
    weight = np.minimum(size, 1000)
    expected = np.array([np.average(value[label == y], weights=weight[label == y]) if (label == y).any() else np.average(value, weights=weight)
                         for y in range(k)])
    # squared misses = variance of texts + variance of n-grams / their number, by least squares
    square = (value - expected[label]) ** 2
    x = np.stack([np.ones_like(size), 1 / size], axis=1) * np.sqrt(weight)[:, None]
    a, b = np.linalg.lstsq(x, square * np.sqrt(weight), rcond=None)[0]
    least = float(square.mean()) / 100
    return table, expected, (max(float(a), least), max(float(b), least))


def fit(docs: DataFrame, max_rows: int = FIT_ROWS) -> Model:
    """The model of rows (doc_id, text, lang)."""
    rows, _ = labelled_sample(docs, docs.select("doc_id", F.col("lang").alias("label")), max_rows)
    rows = [r for r in rows if has_letter(r["text"])]
    labels = sorted({r["label"] for r in rows})
    if not labels:
        return Model([], np.zeros((1 << BITS, 0)), 1.0)
    df, n = document_frequencies(docs)
    idf = (np.log((1 + n) / (1 + df)) + 1) * SCALE
    model, held, learned = Ftrl(len(labels)), [], []
    words: tuple[list, list] = [], []
    rng = np.random.default_rng(7)

    def sparse(text: str) -> tuple:
        c = counts(text)
        s = np.flatnonzero(c).astype(np.int32)
        return s, c[s].astype(np.int32), labels.index(r["label"])

    for r in rows:
        out = zlib.crc32(b"t%s" % str(r["doc_id"]).encode()) % 5 == 0
        (held if out else learned).append(sparse(r["text"]))
        words[out].append(sparse(words_only(r["text"])))

    def scaled(at: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (c / c.sum() * idf[at]).astype(np.float32)

    for _ in range(EPOCHS):
        for i in rng.permutation(len(learned)):
            at, c, y = learned[i]
            model.learn(at, scaled(at, c), y)
    w = model.weights()
    out = held or learned
    t = _temperature(np.array([scaled(at, c) @ w[at] for at, c, _ in out]), np.array([y for _, _, y in out])) if out else 1.0
    return Model(labels, w * idf[:, None], t, *_likelihoods(*words, len(labels)))


def predict(rows: DataFrame, model: Model, measure: bool = False) -> DataFrame:
    """``rows`` with lang_pred, score and, if to be measured, strangeness of their ``text``; only the
    text goes to Python."""

    @F.pandas_udf("lang_pred string, score double, strangeness double")
    def guess(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = model.weights / model.temperature
        for s in texts:
            out = []
            for text in s:
                if model.labels and has_letter(text):
                    n = counts(text)
                    p = _softmax(n @ table / n.sum())
                    best = int(p.argmax())
                    strange = model.strangeness(counts(words_only(text)), best) if measure else None
                    out.append((model.labels[best], float(min(1.0, p.max())), strange))
                else:
                    out.append(("und", 0.0, 0.0))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "strangeness"])

    rows = rows.drop("lang_pred", "score", "strangeness")
    return rows.withColumn("_g", guess("text")).select("*", "_g.lang_pred", "_g.score", *["_g.strangeness"] * measure).drop("_g")


def recognised(docs: DataFrame, strange: float = STRANGE) -> DataFrame:
    """The rows of ``docs`` whose text is in a recognised language: not ``und``, and less strange
    than ``strange`` to the language it resembles most.  All columns stay as they are.  The score is
    no part of it: a low one is mostly a short text, not a bad one."""
    model = fit(docs)
    return predict(wrapped(docs), model, measure=True).where((F.col("lang_pred") != "und") & (F.col("strangeness") < strange)).select("row.*")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", fold("doc_id", 5) == 0)
    model = fit(docs.where(~F.col("held_out")))
    return predict(docs, model).select("doc_id", "held_out", "lang_pred", "score")
