import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import topk


def slow(rows, k):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            vectors[i] = [math.floor(256 * x) for x in v]
    out = []
    for q, v in vectors.items():
        if q % 50 == 0:
            others = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors.items() if i != q and len(w) == len(v)]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(others)[:k], 1)]
    return sorted(out)


def ask(spark, rows, k=5):
    frame = spark.createDataFrame(
        [(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, node int, query string"
    )
    found = topk.exact_top_k(topk.quantized(frame), F.col("vec_id") % 50 == 0, k)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())


@pytest.mark.parametrize("blocks", [(16_384, 256), (40, 3)])
def test_brute_force_with_ties(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "LIST_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[1])
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(120)]
    rows += [rows[3], (None, [1.0] * 4), (2000, None), (2050, [1.0, None, 1.0, 1.0])]
    rows += [(2100, [float("nan"), 1.0, 1.0, 1.0]), (2150, [float("inf")] * 4), (2200, []), (2201, [])]
    rows += [(3000, [1.0, 2.0]), (3001, [3.0, -1.0]), (3050, [0.0, 0.0])]
    assert ask(spark, rows) == slow(rows, 5)


def test_few_and_none(spark):
    assert ask(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]
    assert ask(spark, [(0, [1.0])]) == []
    assert ask(spark, []) == []


@pytest.mark.parametrize("scale", [300, 2**30])
def test_reading_finds_the_best(scale):
    rng = np.random.default_rng(0)
    vectors, queries = rng.integers(-scale, scale, (200, 8)), rng.integers(-scale, scale, (20, 8))
    queries[0], queries[1, 1:] = 0, 0
    scores = queries @ vectors.T
    for query, (rows, found) in zip(scores, topk.SortedLists(vectors).top(queries, 6)):
        best = np.sort(query)[-6]
        assert set(rows) >= set(np.flatnonzero(query > best)) and set(rows) <= set(np.flatnonzero(query >= best))
        assert len(rows) >= 6 and (found == query[rows]).all()


def test_dropped_rows_are_outsiders():
    rng = np.random.default_rng(1)
    vectors, queries = rng.integers(-50, 50, (500, 6)), rng.integers(-50, 50, (10, 6))
    scores = vectors @ queries.T
    reading = topk.Reading(topk.SortedLists(vectors), queries, 4)
    for depth in (50, 200, 350, 450):
        reading._read_to(depth)
        before = reading.open
        reading._drop_outsiders()
        for column, query in enumerate(reading.open):
            out = scores[~reading.alive[column], query]
            assert (out < np.sort(scores[:, query])[-4]).all()
        for query in set(before) - set(reading.open):
            rows, found = reading.found[query]
            assert sorted(found) == sorted(np.sort(scores[:, query])[-4:])


def test_reading_the_given_vectors_stops_before_the_end():
    """Vectors without structure, the hardest case: outsiders are gone at four fifths or so.

    The lists hold row numbers and values by value: there is nothing to score a row from.
    """
    rows = duckdb.sql("SELECT embedding FROM '/root/testdata/sf0.1/embeddings.parquet'").fetchall()
    vectors = np.floor(256 * np.array([v for (v,) in rows], dtype=np.float32).astype(float)).astype(np.int64)
    lists, queries = topk.SortedLists(vectors), vectors[::50]
    assert set(vars(lists)) == {"n", "dim", "order", "values", "read"}
    reading = topk.Reading(lists, queries, 6)
    found = reading.finish()
    assert not len(reading.open) and reading.depth < len(vectors)
    share = lists.read / (queries.size * len(vectors))
    print("share of entries read", share)
    assert share < 0.95
    for query, (own, scores) in zip(queries, found):
        assert sorted(scores) == sorted(np.sort(vectors @ query)[-6:])
