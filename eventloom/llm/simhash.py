"""Near-duplicate groups by SimHash fingerprints and pigeonring filtering."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import (
    as_bytes,
    by_text,
    free_memory,
    materialize,
    same_text,
    shuffle_partitions,
    whole_rows,
)
from eventloom.llm.graph import connected_components

SEGMENTS = 8
MAX_BITS = 3
#: A bucket of more fingerprints is split further, on more of their bits. Comparing this many
#: in one task takes seconds; splitting sends each row on four times, so it is for more only.
BUCKET = 16_384
_FULL = (1 << 64) - 1


def text_fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Bit i: set in over half the XXH64 of all word shingles (no words: 0)."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(line, seed)
    starts = list(accumulate(map(len, words), lambda at, size: at + size + 1, initial=0))
    counts, n = np.zeros(64, dtype=np.int64), len(words) - shingle + 1
    for first in range(0, n, 1 << 16):
        part = slice(first, min(n, first + (1 << 16)))
        ends = starts[part.start + shingle : part.stop + shingle]
        hashes = [digest(line[a : b - 1], seed) for a, b in zip(starts[part], ends)]
        octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text_key, fp) of every row of documents; null text counts as empty."""

    def run(batch):
        texts = as_bytes(batch.column(1)).to_pylist()
        marks = np.array([text_fingerprint(t, shingle, seed) for t in texts], dtype=np.uint64)
        columns = [batch.column(0), batch.column(2), pa.array(marks.view(np.int64))]
        yield pa.record_batch(columns, ["doc_id", "text_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    return by_text(run, rows, "doc_id long, text_key long, fp long")


def _segments(first: int, count: int) -> int:
    """Mask of ``count`` consecutive segments on the ring."""
    width = 64 // SEGMENTS
    return sum(((1 << width) - 1) << width * ((first + i) % SEGMENTS) for i in range(count))


def chain_budgets(max_bits: int) -> list[int]:
    """Most differing bits of the first l segments of a chain, l from 1."""
    return [length * max_bits // SEGMENTS for length in range(1, SEGMENTS + 1)]


def bucket_masks() -> list[tuple[int, int]]:
    """(chain start, bits that must be equal) of the first buckets.

    Two fingerprints within 3 bits have a chain whose first two segments are equal and
    whose first five differ in one bit at most, so two of the next three are equal too.
    """
    return [
        (first, _segments(first, 5) & ~_segments(first + skipped, 1))
        for first in range(SEGMENTS)
        for skipped in (2, 3, 4)
    ]


def split_mask(mask: int) -> list[int]:
    """Four larger masks; fingerprints that agree on ``mask`` and are within 3 bits agree on one."""
    free = [i for i in range(64) if not mask >> i & 1]
    parts = np.array_split(free, MAX_BITS + 1)
    return [mask | sum(1 << int(i) for i in part) for part in parts]


def _root(parent: np.ndarray, node: int) -> int:
    while parent[node] != node:
        parent[node] = parent[parent[node]]
        node = parent[node]
    return node


def link_buckets(fp: np.ndarray, start: np.ndarray, bucket: np.ndarray, max_bits: int):
    """Links (i, j) that span the components inside buckets; rows of a bucket are adjacent."""
    n = len(fp)
    parent, links, budgets = np.arange(n), [], chain_budgets(max_bits)
    masks = np.array(
        [[_segments(s, k) for k in range(1, SEGMENTS + 1)] for s in range(SEGMENTS)], dtype=np.uint64
    )
    # only the lengths at which a chain is longest for its budget can prune more
    lengths = [k for k in range(SEGMENTS) if k + 1 == SEGMENTS or budgets[k + 1] > budgets[k]]
    left = np.arange(n)
    for lag in range(1, n):
        left = left[left + lag < n]
        left = left[bucket[left] == bucket[left + lag]]
        if not len(left):
            break
        open_ = left[parent[left] != parent[left + lag]]
        differ = fp[open_] ^ fp[open_ + lag]
        for k in lengths:
            keep = np.bitwise_count(differ & masks[start[open_], k]) <= budgets[k]
            open_, differ = open_[keep], differ[keep]
        for i in open_.tolist():
            a, b = _root(parent, i), _root(parent, i + lag)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((i, i + lag))
        if len(open_):
            while (up := parent[parent]).tolist() != parent.tolist():
                parent = up
    return links


def _bucket_pass(max_bits: int, most: int):
    """Streams sorted rows: links of buckets, and the rows of too large buckets once more."""

    def run(batches):
        rest, hot = None, None  # rows of a bucket that may go on; a large one that does
        for (fp, start, mask), last in _parts(batches):
            if rest is not None:
                fp, start, mask = (np.concatenate(x) for x in zip(rest, (fp, start, mask)))
            rest = None
            if not len(fp):
                continue
            key = fp & mask
            new = np.ones(len(fp), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (mask[1:] != mask[:-1])
            bucket = np.cumsum(new) - 1
            size = np.bincount(bucket)[bucket]
            large = size > most
            if (key[0], mask[0]) == hot:
                large |= bucket == 0
            hot = (key[-1], mask[-1]) if large[-1] else None
            yield from _again(fp[large], start[large], mask[large])
            some = ~large
            if not last and hot is None:
                goes_on = bucket == bucket[-1]
                rest = fp[goes_on], start[goes_on], mask[goes_on]
                some &= ~goes_on
            some &= size > 1
            f, s, b = fp[some], start[some].astype(np.int64), bucket[some]
            links = np.array(link_buckets(f, s, b, max_bits), dtype=np.int64).reshape(-1, 2)
            if len(links):
                yield _rows(f[links[:, 0]], f[links[:, 1]], None, None)

    return run


def _rows(a, b, start, mask):
    n = len(a)
    none = pa.nulls(n, pa.int64())
    return pa.record_batch(
        [
            pa.array(a.view(np.int64)),
            none if b is None else pa.array(b.view(np.int64)),
            pa.nulls(n, pa.int32()) if start is None else pa.array(start.astype(np.int32)),
            none if mask is None else pa.array(mask.view(np.int64)),
        ],
        ["a", "b", "start", "mask"],
    )


def _again(fp, start, mask):
    for m in np.unique(mask):
        own = mask == m
        for wider in split_mask(int(m)):
            yield _rows(fp[own], None, start[own], np.full(int(own.sum()), wider, dtype=np.uint64))


def _parts(batches):
    """((fp, start, mask), is last) of each batch, then an empty last one."""
    for batch in batches:
        fp, start, mask = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        yield (fp.view(np.uint64), start, mask.view(np.uint64)), False
    yield (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint64)), True


def fingerprint_links(marks: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that span all their components.

    Every fingerprint goes to 24 buckets, each of which fixes 32 of its bits; two within
    ``max_bits`` meet in one whose pigeonring chain they pass. Buckets of over ``bucket``
    fingerprints go round again on more bits, until few bits are free, so no bucket compares
    more than that many with each other and no link is lost.
    """
    if not 0 <= max_bits <= MAX_BITS or bucket < 16:
        raise ValueError(f"max_bits must be 0 to {MAX_BITS}, bucket 16 or more")
    spans = [f"named_struct('start', {s}, 'mask', {_as_long(m)}L)" for s, m in bucket_masks()]
    rows = marks.select("fp", F.expr(f"inline(array({', '.join(spans)}))"))
    found, parts = None, shuffle_partitions(marks)
    while True:
        keyed = rows.repartition(parts, F.col("mask"), F.expr("fp & mask")).sortWithinPartitions(
            "mask", F.expr("fp & mask"), "fp"
        )
        done = materialize(
            keyed.select("fp", "start", "mask").mapInArrow(
                _bucket_pass(max_bits, bucket), "a long, b long, start int, mask long"
            ),
            "links",
        )
        links = done.where("b IS NOT NULL").select("a", "b")
        found = links if found is None else found.unionByName(links)
        rows = done.where("b IS NULL").select(F.col("a").alias("fp"), "start", "mask")
        free_memory(marks.sparkSession)
        if rows.isEmpty():
            return found.distinct()


def _as_long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_duplicates(
    docs: DataFrame, shingle: int = 3, seed: int = 42, max_bits: int = MAX_BITS
) -> DataFrame:
    """(doc_id, fingerprint, component_id, root, text_key) of every row of documents.

    Documents whose fingerprints differ in ``max_bits`` bits or fewer are linked;
    component_id is the least doc_id that links reach, the own one included. Equal
    fingerprints, so all copies, are one node, represented by their least doc_id, before
    anything is compared. Null, empty or blank texts have fingerprint zero and are linked
    like any other. Repeated rows come back as often as they came in; rows with a null
    doc_id take part, and their component's id is its least doc_id that is not null; root,
    the least fingerprint, names a component in any case. text_key is a hash of the text.
    Other columns are ignored; no documents give no rows.
    """
    marks = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    nodes = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected_components(fingerprint_links(nodes, max_bits))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = materialize(named, "named")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = named.join(ids, "root").select("fp", "root", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marks.join(ids, "fp").select("doc_id", hexed, "component_id", "root", "text_key")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents without their near duplicates: of each component the least doc_id stays.

    All columns stay. Equal rows of that document count as one; of a component without any
    doc_id the text of least hash stays. See ``near_duplicates``.
    """
    found = near_duplicates(docs, shingle, max_bits=max_bits)
    first = Window.partitionBy("root").orderBy(F.asc_nulls_last("doc_id"), "text_key")
    kept = found.withColumn("n", F.row_number().over(first)).where("n = 1")
    return one_row_each(docs, kept.select("doc_id", "text_key"))


def one_row_each(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of the documents for each (doc_id, text_key) of ``kept``."""
    rows = whole_rows(docs).join(kept, same_text(kept), "left_semi")
    one = Window.partitionBy("own_id", "own_key").orderBy("own_id")
    rows = rows.withColumn("place", F.row_number().over(one)).where("place = 1")
    return rows.select("document.*")
