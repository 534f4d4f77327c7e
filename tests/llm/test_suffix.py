import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.llm import suffix_dedup
from tests.llm import fixtures


def slow(rows, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) by looking at every string."""
    last = 1 << 63
    least = {}
    for r in rows:
        data = (r[1] or "").encode()
        for i in range(len(data) - length + 1):
            key = data[i : i + length]
            least[key] = min(least.get(key, last), last - 1 if r[0] is None else r[0])
    out = []
    for r in rows:
        data, own = (r[1] or "").encode(), last - 1 if r[0] is None else r[0]
        gone = np.zeros(len(data) + 1, dtype=bool)
        for i in range(len(data) - length + 1):
            if least[data[i : i + length]] < own:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((r[0], len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(frame, **more):
    return sorted((tuple(r)[:5] for r in suffix_dedup.remove_repeats(frame, **more).collect()), key=str)


SMALL = [
    {},
    {"SHARD_BYTES": 400},
    {"DENSE": 1},
    {"HOT_RUNS": 1},
    {"DENSE": 3, "SHARD_BYTES": 1000, "HOT_RUNS": 4},
]


@pytest.mark.parametrize("limits", SMALL)
def test_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = [r for r in fixtures.rows() if len(r[1] or "") < 30_000]
    long = fixtures.texts()[17]
    rows += [(400, long[:3000], *rows[0][2:]), (390, long[1000:2000] + "x" + long[500:900], *rows[0][2:])]
    rows += [(10, "another text of id ten " + long[:200], *rows[0][2:])]
    assert got(fixtures.frame(spark, rows).repartition(4)) == slow(rows)


def test_few_letters(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices("ab\0", k=rng.randint(0, 400)))) for i in range(60)]
    assert got(fixtures.plain(spark, rows), length=16) == slow(rows, 16)


def test_kept_text_and_empty(spark):
    rows = [(1, "x" * 10 + "é" * 60), (2, "y" + "é" * 60 + "z")]
    kept = {r.doc_id: r.kept for r in suffix_dedup.remove_repeats(fixtures.plain(spark, rows), keep_text=True).collect()}
    assert kept == {1: rows[0][1].encode(), 2: b"yz"}
    assert got(fixtures.frame(spark, [])) == []


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=300) | st.text("ab\0", min_size=1, max_size=300).map(str.encode))
def test_suffix_array_and_prefixes(data):
    raw = np.frombuffer(data, dtype=np.uint8)
    order = suffix_dedup.suffix_array(raw)
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    starts = np.arange(0, len(data), 7)
    common = suffix_dedup.common_prefixes(raw, order, starts, 50)
    for a, b in zip(order, order[1:]):
        x, y = data[a:], data[b:]
        n = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert common[b] == min(n, 50)
    assert common[order[0]] == 0


@pytest.mark.parametrize("places", [1, 3, 1024])
def test_copies_of_one_text_are_dealt(spark, monkeypatch, places):
    monkeypatch.setattr(suffix_dedup, "PLACES", places)
    rng = random.Random(places)
    kinds = ["same " * 20, "other " * 20, "short", "é" * 25]
    rows = [(rng.randint(1, 300), 0, rng.choice(kinds)) for _ in range(600)]
    texts = spark.createDataFrame(rows, "doc long, variant long, text string").repartition(7)
    found = suffix_dedup.copies(texts, 50)
    least = {t: min(d for d, _, u in rows if u == t) for t in kinds}
    wanted = [(d, v, len(t.encode())) for d, v, t in rows if len(t.encode()) >= 50 and d > least[t]]
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    joined = [line for line in found._jdf.queryExecution().toString().splitlines() if "Join [" in line]
    assert joined and all("place#" in line for line in joined)


def test_rows_of_one_id_and_text(spark):
    rows = [(r, "the same words again and again " * 4) for r in [3, 3, None, None, 2, 2, 5]]
    assert got(fixtures.plain(spark, rows).repartition(3)) == slow(rows)


@settings(max_examples=60, deadline=None)
@given(st.text("ab\0", min_size=60, max_size=400).map(str.encode), st.integers(20, 50))
def test_suffixes_at_some_places_and_of_some_bytes(data, most):
    raw = np.frombuffer(data, dtype=np.uint8)
    places = np.arange(3, len(data), 2)
    order = suffix_dedup.suffix_array(raw, places, most)
    assert sorted(order) == places.tolist()
    found = [data[i : i + most] for i in order]
    assert found == sorted(found)
    common = suffix_dedup.common_prefixes(raw, order, places, most)
    assert [common[b] == most for b in order[1:]] == [len(y) == most and x == y for x, y in zip(found, found[1:])]


RUN = ["name", "doc", "variant", "start", "stop", "context"]


def run_batches(runs, rows):
    columns = [pa.array(c, t) for c, t in zip(zip(*runs), [pa.int64()] * 5 + [pa.binary()])]
    return iter(pa.Table.from_arrays(columns, RUN).to_batches(max_chunksize=rows))


def test_only_strings_are_sorted(monkeypatch):
    sizes, plain = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: (sizes.append(len(x)), plain(x, *a, **k))[1])
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcdefgh", k=66)).encode() for _ in range(300)]
    runs = [(i, doc, 0, 0, None, t + end) for i, t in enumerate(texts) for doc, end in [(1, b"x"), (2, b"y")]]
    found = [tuple(r.values()) for b in suffix_dedup._compare(50)(run_batches(runs, 100)) for r in b.to_pylist()]
    assert found == [(2, 0, 0, 66)] * 300
    # 18 strings in 67 bytes, once each, and the few that 8 bytes do not tell apart
    assert sum(sizes) < 2.5 * 600 * 18


@pytest.mark.parametrize("size", [50, 64, 1000])
def test_names_do_not_depend_on_passes(monkeypatch, size):
    rng = random.Random(size)
    parts = ["".join(rng.choices("abc", k=rng.randint(0, 300))).encode() for _ in range(40)]
    data, offsets = b"".join(parts), np.cumsum([0, *map(len, parts)])
    whole = suffix_dedup.name_runs(data, offsets, 50)
    monkeypatch.setattr(suffix_dedup, "PASS", size)
    assert all(np.array_equal(x, y) for x, y in zip(whole, suffix_dedup.name_runs(data, offsets, 50)))
    strings = [(t, i) for t, p in enumerate(parts) for i in range(len(p) - 49)]
    found = [(t, p - offsets[t] + i) for _, t, p, n in zip(*whole) for i in range(n)]
    assert found == strings


@pytest.mark.parametrize("rows", [1, 2, 5, 100])
def test_copies_over_batches(rows):
    same, other = b"x" * 30 + b"y" * 40, b"x" * 30 + b"z" * 40
    runs = [(1, 9, 0, 5, 60, None)]
    runs += [(1, d, 0, 0, None, same) for d in (3, 3, 4, 8)] + [(1, d, 0, 0, None, other) for d in (2, 7)]
    runs += [(2, d, 0, 0, None, other) for d in (1, 6)]
    batches = run_batches(runs, rows)
    found = [tuple(r.values()) for b in suffix_dedup._compare(50)(batches) for r in b.to_pylist()]
    assert sorted(found) == [(4, 0, 0, 70), (6, 0, 0, 70), (7, 0, 0, 70), (8, 0, 0, 70), (9, 0, 5, 60)]
