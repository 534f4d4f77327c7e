import hashlib
import random
import re

import pytest

from eventloom.llm import decontaminate
from tests.llm import fixtures

ITEMS = "item_id long, text string, doc_id string, passage int"


def tokens(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def slow(text, items):
    words, hit, found = tokens(text), set(), set()
    for key, own in items:
        own = tokens(own)
        if key is None or not own:
            continue
        n = min(13, len(own))
        for i in range(len(own) - n + 1):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(key))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)


def items_of(spark, items):
    return spark.createDataFrame([(a, b, "x", 1) for a, b in items], ITEMS)


@pytest.mark.parametrize("bits", [24, 8])
def test_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)
    texts = fixtures.texts()
    items = [
        (1, texts[12]),
        (2, "One two"),
        (3, "x " + texts[12] + " y"),
        (11, texts[12]),
        (4, ""),
        (5, None),
        (None, texts[0]),
        (6, "...!"),
        (7, "été"),
        (8, "a a a a a a a a a a a a a a a"),
        (3, "x " + texts[12] + " y"),
        (9, texts[4]),
    ]
    rows = [*fixtures.rows(), (500, "a " * 40, *fixtures.rows()[0][2:])]
    got = decontaminate.contamination(fixtures.frame(spark, rows), items_of(spark, items)).collect()
    want = sorted(((r[0], *slow(r[1], items)) for r in rows), key=str)
    assert sorted((tuple(r)[:-1] for r in got), key=str) == want
    assert any(w[2] for w in want)


def test_random_passages(spark):
    rng = random.Random(2)
    vocabulary = ["a", "b", "c", "d"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(80)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 5)))) for i in range(12)]
    got = decontaminate.contamination(fixtures.plain(spark, docs), items_of(spark, items)).collect()
    assert sorted(tuple(r)[:-1] for r in got) == sorted((i, *slow(t, items)) for i, t in docs)


def test_empty_tables(spark):
    docs, none = fixtures.frame(spark), items_of(spark, [])
    assert not any(r.contaminated for r in decontaminate.contamination(docs, none).collect())
    assert decontaminate.contamination(fixtures.frame(spark, []), none).collect() == []


def test_drop(spark):
    items = items_of(spark, [(1, fixtures.texts()[12])])
    kept = decontaminate.drop_contaminated(fixtures.frame(spark), items)
    assert kept.columns == fixtures.frame(spark).columns
    rows = fixtures.rows()
    want = [r for r in rows if not slow(r[1], [(1, fixtures.texts()[12])])[-1]]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)
    assert 130 not in [r[0] for r in want] and 150 in [r[0] for r in want]
