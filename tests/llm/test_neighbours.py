import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import neighbours

FOLDER = "/root/testdata/sf0.1"


def slow(rows, k, every=100):
    vectors = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            vectors[i] = v
    out = []
    for q, v in vectors.items():
        if q % every == 0:
            others = [(math.dist(v, w), i) for i, w in vectors.items() if i != q and len(w) == len(v)]
            out += [(q, n, i, s) for n, (s, i) in enumerate(sorted(others)[:k], 1)]
    return sorted(out)


def ask(spark, rows, k=10, **bounds):
    frame = spark.createDataFrame(
        [(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, node int, place string"
    )
    found = neighbours.nearest(neighbours.usable_vectors(frame), F.col("vec_id") % 100 == 0, k, **bounds)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())


def close(got, want):
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("shard", [32_768, 60])
def test_whole_search_is_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(neighbours, "SHARD", shard)
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(500)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(120)]
    rows += [rows[3], (None, [1.0] * 4), (2000, None), (2100, [1.0, None, 1.0, 1.0]), (2400, [0.0] * 4)]
    rows += [(2200, [float("nan"), 1.0, 1.0, 1.0]), (2300, [float("inf")] * 4), (2500, []), (2501, [])]
    rows += [(3000, [1.0, 2.0]), (3001, [3.0, -1.0]), (3100, [0.0, 4.0]), (3200, [7.0])]
    close(ask(spark, rows), slow(rows, 10))


def test_few_and_none(spark):
    assert ask(spark, [(0, [1.0]), (1, [3.0])]) == [(0, 1, 1, 2.0)]
    assert ask(spark, [(0, [1.0])]) == []
    assert ask(spark, []) == []


def test_gaps_never_exceed_distances():
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(700, 12))
    forest = neighbours.Forest(vectors, trees=3, leaf=8)
    for query in rng.normal(size=(5, 12)):
        gaps, met = [], np.zeros(700, dtype=int)
        for gap, rows in forest.leaves(query):
            gaps.append(gap)
            met[rows] += 1
            assert (((vectors[rows] - query) ** 2).sum(axis=1) >= gap - 1e-9).all()
        assert gaps == sorted(gaps) and (met == 3).all()


def test_clusters_stop_early_and_exactly():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(50, 16)) * 10
    vectors = np.repeat(centres, 100, axis=0) + rng.normal(size=(5000, 16)) / 100
    forest, looked = neighbours.Forest(vectors), []
    look = forest._look
    forest._look = lambda *a: looked.append(look(*a)) or looked[-1]
    for query in vectors[::500]:
        looked.clear()
        rows, _ = forest.nearest(query, 11, 5000)
        assert set(rows) == set(np.argsort(((vectors - query) ** 2).sum(axis=1))[:11])
        assert sum(new for *_, new in looked) < 2500


def test_recall_on_vectors_without_structure():
    """The given vectors have no near neighbours at all, the hardest case."""
    found = duckdb.sql(f"SELECT embedding FROM '{FOLDER}/embeddings.parquet'").fetchall()
    given = np.array([v for (v,) in found], dtype=float)
    rng = np.random.default_rng(5)
    more = rng.normal(size=(20_000, 64))
    vectors = np.concatenate([given, more / np.linalg.norm(more, axis=1)[:, None]])
    forest, hits = neighbours.Forest(vectors), []
    for q in range(0, 2000, 50):
        rows, _ = forest.nearest(vectors[q], 11, math.ceil(neighbours.SHARE * len(vectors)))
        best = np.argsort(((vectors - vectors[q]) ** 2).sum(axis=1))[:11]
        hits.append(len(set(rows) & set(best)) / 11)
    assert np.mean(hits) >= 0.93
