import random
import zlib
from collections import Counter, defaultdict

import pytest

from eventloom.llm.sharding import shard_documents
from tests.llm import fixtures


def check(rows, got, shards):
    assert len(got) == len(rows)
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_edge_cases(spark):
    rows = fixtures.rows()
    check(rows, shard_documents(fixtures.frame(spark), 4).collect(), 4)
    assert shard_documents(fixtures.frame(spark, [])).collect() == []


@pytest.mark.parametrize("copies", [0, 500])
def test_near_equal_bytes_and_whole_groups(spark, copies):
    rng = random.Random(6)
    rows = [(i, "x" * rng.randint(0, 300) + str(i % 900)) for i in range(3000)]
    rows += [(5000 + i, "the same text of every copy " * 20) for i in range(copies)]
    got = shard_documents(fixtures.plain(spark, rows).repartition(6), 8, bundles=512).collect()
    sizes = check(rows, got, 8)
    mean = sum(sizes.values()) / 8
    assert max(sizes.values()) <= 1.02 * mean and min(sizes.values()) >= 0.98 * mean
    texts, where = dict(rows), defaultdict(set)
    for r in got:
        where[texts[r.doc_id]].add(r.shard)
    split = [t for t, s in where.items() if len(s) > 1]
    # only a group of more than a shard's share may be split
    assert split == ([] if not copies else [rows[-1][1]])
    if not copies:
        counts = Counter(r.shard for r in got)
        assert max(counts.values()) <= 1.1 * min(counts.values())
