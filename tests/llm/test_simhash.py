import random
import re

import numpy as np
import pytest
import xxhash

from eventloom.llm import simhash
from eventloom.llm.graph import connected_components
from tests.llm import fixtures


def slow_fingerprint(text, shingle=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def slow_roots(marks, most=3):
    marks = sorted(set(marks))
    parent = {m: m for m in marks}

    def root(m):
        while parent[m] != m:
            m = parent[m]
        return m

    for i, a in enumerate(marks):
        for b in marks[:i]:
            if (a ^ b).bit_count() <= most:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {m: root(m) for m in marks}


def test_components_match_brute_force(spark):
    data = fixtures.rows()
    got = simhash.near_duplicates(fixtures.frame(spark)).collect()
    marks = [slow_fingerprint(r[1]) for r in data]
    roots = slow_roots(marks)
    least = {}
    for r, m in zip(data, marks):
        if r[0] is not None:
            least[roots[m]] = min(least.get(roots[m], r[0]), r[0])
    want = sorted(((r[0], format(m, "016x"), least.get(roots[m])) for r, m in zip(data, marks)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want


def near_marks(rng, groups, size, flips):
    marks = set()
    for _ in range(groups):
        base = rng.getrandbits(64)
        bits = rng.sample(range(64), 12)
        for _ in range(size):
            marks.add(base ^ sum(1 << b for b in rng.sample(bits, rng.randint(0, flips))))
    return sorted(marks)


@pytest.mark.parametrize("bucket", [64, simhash.BUCKET])
def test_no_link_is_lost(spark, bucket):
    """Dense groups, so that small buckets are split more than once."""
    marks = near_marks(random.Random(3), 3, 90, 4)
    signed = [int(np.uint64(m).astype(np.int64)) for m in marks]
    frame = spark.createDataFrame([(m,) for m in signed], "fp long").repartition(3)
    links = simhash.fingerprint_links(frame, bucket=bucket)
    found = {(r.a % 2**64, r.b % 2**64) for r in links.collect()}
    assert all((a ^ b).bit_count() <= 3 for a, b in found)
    parent = {m: m for m in marks}

    def root(m):
        while parent[m] != m:
            m = parent[m]
        return m

    for a, b in found:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert {m: root(m) for m in marks} == slow_roots(marks)


def test_masks_meet_every_pair():
    rng = random.Random(5)
    masks = [m for _, m in simhash.bucket_masks()]
    for _ in range(2000):
        differ = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(differ & m == 0 for m in masks)


def test_keep_one(spark):
    data = fixtures.rows()
    kept = simhash.keep_one(fixtures.frame(spark))
    assert kept.columns == fixtures.frame(spark).columns
    got = kept.collect()
    marks = [slow_fingerprint(r[1]) for r in data]
    assert len(got) == len(set(slow_roots(marks).values()))
    ids = [r.doc_id for r in got]
    assert ids.count(10) == 1 and 20 not in ids and 80 in ids and 90 not in ids


def test_empty(spark):
    assert simhash.near_duplicates(fixtures.frame(spark, [])).collect() == []
    assert simhash.keep_one(fixtures.frame(spark, [])).collect() == []


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(40)]
    edges = [*chain, (100, 99), (100, 101), (99, 101), (7, 7), (200, 200), (None, 1), (40, 0)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {i: 0 for i in range(41)} | {99: 99, 100: 99, 101: 99, 200: 200}
    assert {r.node: r.root for r in got} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
