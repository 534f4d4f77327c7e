import random

import pytest

from eventloom.llm import quality
from eventloom.llm.quality import SAMPLE_BYTES, fitting_sample, quality_scores
from tests.llm import fixtures

LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(n, seed):
    """(id, text, quality, toxic): junk is shouted, toxic texts have one of three words."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text, kind = fixtures.words(rng, rng.randint(30, 80)), rng.random()
        quality, toxic = int(kind > 0.25), int(rng.random() < 0.3)
        if not quality:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if toxic:
            own = text.split()
            for _ in range(2):
                own.insert(rng.randint(0, len(own)), rng.choice(["vilest", "rotter", "swinish"]))
            text = " ".join(own)
        out.append((i, text, quality, toxic))
    return out


def test_held_out_accuracy(spark):
    data = corpus(1500, 1)
    labels = spark.createDataFrame([(i, q, t, "x") for i, _, q, t in data[:700]], LABELS)
    docs = fixtures.plain(spark, [(i, t) for i, t, _, _ in data])
    got = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    held = data[700:]
    right = sum((got[i].p_quality > 0.5) == q for i, _, q, _ in held)
    toxic = sum((got[i].p_toxic > 0.5) == t for i, _, _, t in held)
    assert right >= 0.97 * len(held) and toxic >= 0.97 * len(held)
    clean = [i for i, _, q, t in held if q and not t]
    assert sum(got[i].keep for i in clean) >= 0.98 * len(clean)


@pytest.mark.parametrize("labels", [[], [(10, 1, 0, "x")], [(10, None, None, "x"), (None, 1, 1, "x")]])
def test_edge_cases(spark, labels):
    docs = fixtures.frame(spark)
    got = quality_scores(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(fixtures.rows())
    assert all(r.keep and 0 <= r.score <= 1 for r in got)
    assert sorted([(r.doc_id, r.text) for r in got], key=str) == sorted([r[:2] for r in fixtures.rows()], key=str)


def test_empty(spark):
    labels = spark.createDataFrame([(10, 1, 0, "x"), (20, 0, 1, "x")], LABELS)
    assert quality_scores(fixtures.frame(spark, []), labels).collect() == []
    assert len(quality_scores(fixtures.frame(spark), labels).collect()) == len(fixtures.rows())


def test_sample_holds_one_row_of_an_id(spark):
    texts = ["a a", "b b", "c c", None, "d" * (SAMPLE_BYTES + 1)]
    rows = [(i, t) for i in (1, 2) for t in texts * 3] + [(3, "other"), (None, "none")]
    docs = fixtures.plain(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.createDataFrame([(1, 1, 0, ""), (3, 0, 1, "")], LABELS)
    got = fitting_sample(docs, labels, ["quality", "toxic"])
    hashes = {r[0]: r[1] for r in docs.selectExpr("text", "xxhash64(text)").collect() if r[0] in texts[:3]}
    least = min(hashes, key=hashes.get)
    assert list(zip(got.doc_id, got.text)) == [(1, least), (2, least), (3, "other")]
    assert got.quality.tolist()[::2] == [1, 0] and got.quality.isna().tolist() == [False, True, False]
    assert {*docs.columns, "quality", "toxic"} == set(got.columns)


def test_fits_in_a_task(spark, monkeypatch):
    data = corpus(300, 3)
    labels = spark.createDataFrame([(i, q, t, "x") for i, _, q, t in data[:200]], LABELS)
    docs = fixtures.plain(spark, [(i, t) for i, t, _, _ in data])
    view = docs.select("doc_id", "text", "lang", "source", "n_chars")
    wanted = ["quality", "toxic"]
    model = quality.fit(fitting_sample(view, labels, wanted), wanted)
    expected = sorted(map(tuple, quality_scores(docs, labels, model).collect()))
    on_driver, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a: on_driver.append(a) or fit(*a))
    got = sorted(map(tuple, quality_scores(docs, labels).collect()))
    assert got == expected and not on_driver
