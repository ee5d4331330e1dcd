import random
import zlib

import numpy as np
import pytest

from sitefold.llm import language_id, quality, sampling, toxicity
from tests.llm.cases import SCHEMA, edge_rows, frame, prose

SOUNDS = {"aa": "tha ing ion ere".split(), "bb": "sch ung eit ich".split(), "cc": "eau oir ux ement".split()}


def _tongue(lang: str, seed: int, n: int) -> str:
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choices(SOUNDS[lang], k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def languages(spark):
    rows = [(i, _tongue(lang, i, 5 + i % 60), lang) for i, lang in enumerate(sorted(SOUNDS) * 60)]
    return spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 34 !", "bb"), (902, _tongue("aa", 1, 9), None)], "doc_id long, text string, lang string")


def test_language_held_out_accuracy(spark, languages):
    held = languages.where("doc_id % 5 = 0")
    model = language_id.fit(languages.where("doc_id % 5 <> 0"))
    rows = language_id.predict(held, model).collect()
    known = [r for r in rows if r["lang"] and r["doc_id"] < 900]
    assert np.mean([r["lang_pred"] == r["lang"] for r in known]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert np.count_nonzero(model[1]) < model[1].size / 2  # the elastic net leaves it sparse
    by_id = {r["doc_id"]: r for r in language_id.predict(languages, model).collect()}
    assert by_id[900]["lang_pred"] == by_id[901]["lang_pred"] == "und"


def test_document_frequencies_count_all(spark, languages):
    df, n = language_id.document_frequencies(languages)
    texts = [r["text"] for r in languages.collect() if r["text"]]
    want = np.zeros_like(df)
    for t in texts:
        want[np.unique(language_id.slots(t))] += 1
    assert n == len(texts) and (df == want).all()


def test_recognised_keeps_columns_and_clean_rows(spark):
    docs = frame(spark)
    out = language_id.recognised(docs)
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert {6, 7, 10, 11} <= set(kept) and not {1, 2, 3, 13} & set(kept)
    assert language_id.recognised(spark.createDataFrame([], SCHEMA)).count() == 0


def test_noise_goes_and_clean_rows_stay(spark):
    """Letter noise and a script nobody learned go from ten words on; short, repetitive, mixed and
    marked-up texts of the learned languages stay."""
    rng = random.Random(11)
    learned = [(i, _tongue(lang, i, 5 + i % 60), lang) for i, lang in enumerate(sorted(SOUNDS) * 200)]
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n)) for n in (10, 40, 400)]
    noise.append("съешь ещё этих мягких французских булок да выпей чаю " * 3)
    rows = [(1000 + i, t, None) for i, t in enumerate(noise)]
    clean = [_tongue("aa", 1, 1), _tongue("bb", 2, 3), "tha " * 400, _tongue("cc", 3, 2000), "A.",
             _tongue("aa", 4, 300) + " " + _tongue("bb", 5, 300), _tongue("bb", 6, 30) + ' token = "40d78a45c418324758e099eb7cb89bc0f5fa9f62" +1 (706) 555-3138',
             " ".join(w + "###" for w in _tongue("cc", 7, 60).split()), _tongue("aa", 8, 80).upper()]
    rows += [(2000 + i, t, None) for i, t in enumerate(clean)]
    docs = spark.createDataFrame(learned + rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in language_id.recognised(docs).collect()}
    assert kept == {*range(600), *range(2000, 2000 + len(clean))}


@pytest.mark.parametrize("text", ["", "one", "a " * 70_000, "x" * 200_000, "wort\n" * 30_000, "été straße " * 9000])
def test_counts_and_words_by_segments(text):
    at = language_id.slots(text)
    assert (language_id.counts(text) == np.bincount(at, minlength=1 << language_id.BITS)).all()
    assert set(language_id.words_only(text).split()) == set(text.split()) or "x" * 200_000 == text


def test_more_labels_than_can_be_learned(spark, monkeypatch):
    monkeypatch.setattr(sampling, "MAX_LABELS", 3)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string")
    rows, counts = sampling.labelled_sample(docs, docs.selectExpr("doc_id", "least(doc_id % 10, 4) as label"), max_rows=12)
    assert counts == {4: 36, 0: 6, 1: 6} and len(rows) <= 12


def _quality_rows():
    out = []
    for i in range(160):
        good = i % 4 != 0
        text = prose(i, 30 + i) if good else " ".join(w.upper() + "!!" for w in prose(i, 30 + i).split())
        out.append((i, text, int(good)))
    return out


def test_quality_held_out(spark):
    rows = _quality_rows()
    docs = frame(spark, [r[:2] for r in rows] + [r for r in edge_rows() if r[0] is None or r[0] < 6])
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (3, None)], "doc_id long, label int")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    model = quality.fit(docs, labels.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) <> 2"))
    out = quality.score(docs, model).collect()
    truth = {i: q for i, _, q in rows if held(i) and i > 5}
    got = {r["doc_id"]: r["score"] for r in out if r["doc_id"] in truth}
    assert np.mean([(got[i] >= 0.7) == bool(q) for i, q in truth.items()]) >= 0.95
    assert all(r["score"] is not None and 0 <= r["score"] <= 1 for r in out)


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, label int")
    assert quality.fit(frame(spark), none) is None
    assert {r["score"] for r in quality.score(frame(spark), None).collect()} == {0.5}


def _toxic_rows():
    rng = random.Random(4)
    rows = []
    for i in range(240):
        sentences = [prose(i * 50 + k, rng.randint(4, 9)) for k in range(rng.randint(2, 12))]
        bad = i % 4 == 0
        where = rng.randrange(len(sentences))
        if bad:
            sentences[where] += " " + rng.choice(["zork", "Blarg", "quux"])
        rows.append((i, ". ".join(sentences), int(bad), where))
    return rows


def test_toxicity_scores_and_sentences(spark):
    rows = _toxic_rows()
    docs = frame(spark, [r[:2] for r in rows] + [(1000, None), (1001, ""), (1002, "...")])
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 3], "doc_id long, label int")
    out = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    assert np.mean([(out[i]["score"] >= 0.5) == bool(bad) for i, _, bad, _ in held]) >= 0.97
    for i, text, bad, where in held:
        if bad and out[i]["score"] >= 0.5:
            start, end = out[i]["starts"][0], out[i]["ends"][0]
            assert text[start:end].strip() == text.split(". ")[where].strip()
    assert [out[i]["score"] for i in (1000, 1001, 1002)] == [0, 0, 0]


def test_noisy_or_against_plain_product():
    model = {b"zork": 9.0, b"bel": -1.0, b"quxqu*": 2.0}, -5.0
    text = "Zork bel zork! quxquxa\nala é quxquxab quxquxa. bel"
    clean = 1.0
    for s in toxicity.SENTENCE.findall(text.encode()):
        z = -5.0
        for w in set(toxicity.words_of(s)):
            z += sum(model[0].get(f, 0.0) for f in toxicity.features(w))
        clean *= 1 - 1 / (1 + np.exp(-z))
    score, starts, ends, _ = toxicity.Scorer(model)(text.encode(), 0.5)
    assert abs(score - (1 - clean)) < 1e-9 and text[starts[0]:ends[0]] == "Zork bel zork"


def test_toxicity_one_label_only(spark):
    labels = spark.createDataFrame([(6, 0), (7, 0)], "doc_id long, label int")
    assert toxicity.fit(frame(spark), labels) is None
    out = toxicity.score(frame(spark), None)
    assert {r["score"] for r in out.collect()} == {0.0}


def test_sample_bounds(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(200)] + [(0, "x" * 100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 10 == 0) for i in range(200)] + [(0, True), (None, True), (5, None)], "doc_id long, label boolean")
    rows, counts = sampling.labelled_sample(docs, labels, max_rows=30)
    assert len(rows) <= 30 and counts == {True: 20, False: 180} and len({r["doc_id"] for r in rows}) == len(rows)
    rows, _ = sampling.labelled_sample(docs, labels, max_rows=30, max_bytes=1000)
    assert sum(len(r["text"]) for r in rows) <= 1000
    assert sampling.labelled_sample(docs, labels.limit(0)) == ([], {})


def test_a_text_over_the_bound_takes_no_other_with_it(spark):
    docs = spark.createDataFrame([(i, ("x" if i % 2 else "y") * (5000 if i in (3, 8) else 20 + i)) for i in range(20)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "doc_id % 2 as label")
    rows, _ = sampling.labelled_sample(docs, labels, max_rows=20, max_bytes=1000)
    assert {r["doc_id"] for r in rows} == set(range(20)) - {3, 8}
    # a label that has only long texts keeps its shortest
    rows, _ = sampling.labelled_sample(docs.where("doc_id % 2 = 0 or doc_id = 3"), labels, max_rows=20, max_bytes=6000)
    assert {r["doc_id"] for r in rows} >= {3, 0, 2, 4}
