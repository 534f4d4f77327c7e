"""Benchmark passages in documents: prefix-filtered join of word shingles, verified exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import (
    blocks,
    by_text,
    find_words,
    free_memory,
    materialize,
    mix,
    same_text,
    signed,
    whole_rows,
)

WINDOW, SHINGLE = 13, 3
#: A document is contaminated if one in so many of its words is hit, or more.
ONE_IN = 20
#: log2 of the bits of the filter that documents read before the join: its size is fixed (2 MiB).
FILTER_BITS = 24

_ODD = [np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)]


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` word hashes."""
    n = max(0, len(words) - size + 1)
    found = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        found = (found ^ words[i : i + n]) * _ODD[i]
        found ^= found >> np.uint64(29)
    return mix(found)


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, passage, length, shingle, place): windows of items, a row for each shingle."""
    schema = "item_id long, passage string, length int, shingle long, place int"

    def run(batch):
        rows = []
        for first, end, data, offsets in blocks(batch.column(1)):
            low, starts, ends, hashes, at = find_words(data, offsets)
            text = low.tobytes()
            for row in range(first, end):
                a, b = at[row - first], at[row - first + 1]
                length = min(window, b - a)
                size = min(SHINGLE, length)
                if not length:
                    continue
                words = [text[s:e].decode() for s, e in zip(starts[a:b], ends[a:b])]
                marks = signed(shingle_hashes(hashes[a:b], size)).tolist()
                for i in range(b - a - length + 1):
                    passage = " ".join(words[i : i + length])
                    for place in range(length - size + 1):
                        key = batch.column(0)[row].as_py()
                        rows.append((key, passage, length, marks[i + place], place))
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32()]
        names = ["item_id", "passage", "length", "shingle", "place"]
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    items = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    return by_text(run, items, schema)


def shingle_filter(shingles: DataFrame) -> np.ndarray:
    """Bits of the slots in use; a slot is the highest bits of a shingle."""
    slot = f"shiftrightunsigned(shingle, {64 - FILTER_BITS})"
    bit = F.expr(f"bit_or(shiftleft(1, CAST({slot} & 31 AS INT)))")
    word = F.expr(f"CAST(shiftright({slot}, 5) AS INT)").alias("word")
    words = shingles.groupBy(word).agg(bit.alias("bits"))
    found = words.toArrow()  # plain arrays: a Row each would cost a hundred times as much
    bits = np.zeros(1 << (FILTER_BITS - 5), dtype=np.uint32)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint32)
    del found
    free_memory(shingles.sparkSession)
    return bits


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - FILTER_BITS)
    return (bits[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32) & 1).astype(bool)


def _sized(hashes: np.ndarray, at: np.ndarray, sizes: list[int]):
    """(first word, hash) of the shingles inside texts, for each size in use."""
    text_end = np.repeat(at[1:], np.diff(at))
    for size in sizes:
        marks = shingle_hashes(hashes, size)
        yield np.arange(size, size + len(marks)) <= text_end[: len(marks)], marks


def occurrences(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """(shingle, n): how often shingles that pass the filter occur, summed for each block."""

    def run(batch):
        for _, _, data, offsets in blocks(batch.column(0)):
            _, _, _, hashes, at = find_words(data, offsets)
            for inside, marks in _sized(hashes, at, sizes):
                found, n = np.unique(marks[inside & passes(bits, marks)], return_counts=True)
                yield pa.record_batch([pa.array(signed(found)), pa.array(n)], ["shingle", "n"])

    return by_text(run, docs.select("text"), "shingle long, n long")


def candidates(docs: DataFrame, bits: np.ndarray, sizes: list[int], around: int) -> DataFrame:
    """A row for each document, and one for each of its shingles that passes the filter.

    The latter have shingle, word (its first word), lead and near: up to ``around`` words
    before it, ``lead`` of them, and as many from its first word on.
    """
    names = ["row", "doc_id", "text_key", "n_words", "shingle", "word", "lead", "near"]
    kinds = [*[pa.int64()] * 6, pa.int32(), pa.list_(pa.string())]

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, end, data, offsets in blocks(batch.column(1)):
                low, starts, ends, hashes, at = find_words(data, offsets)
                count = np.diff(at)
                rows = [
                    (row + i, ids[first + i], keys[first + i], n, None, None, None, None)
                    for i, n in enumerate(count.tolist())
                ]
                text = low.tobytes()
                for inside, marks in _sized(hashes, at, sizes):
                    for p in np.flatnonzero(inside & passes(bits, marks)).tolist():
                        i = int(np.searchsorted(at, p, "right")) - 1
                        a, b = max(int(at[i]), p - around), min(int(at[i + 1]), p + around + SHINGLE)
                        near = [text[s:e].decode() for s, e in zip(starts[a:b], ends[a:b])]
                        mark = int(marks[p : p + 1].view(np.int64)[0])
                        rows.append((row + i, None, None, None, mark, p - int(at[i]), p - a, near))
                row += end - first
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    schema = (
        "row long, doc_id long, text_key long, n_words long, "
        "shingle long, word long, lead int, near array<string>"
    )
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(run, schema)


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, one_in: int = ONE_IN
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_key) of every document.

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased.
    A passage is ``window`` consecutive words of an item, or all words of a shorter item. A
    document that holds a passage holds all its 3-word shingles (all words, if fewer), so
    the rarest of them, by its count over all documents, is prefix enough. Documents send
    only shingles that pass a filter of fixed size; they meet the passages by a join on the
    shingle. The places of the shingle in the passage and of the word in the document bound
    where the passage can lie, and there its words are compared one by one. A passage with
    a shingle that occurs in no document is dropped beforehand. A very frequent shingle is
    one key of an inner join whose rows adaptive execution splits.

    Null or wordless texts have n_words 0 and are clean. Items with null id or without words
    are left out; repeated items count once. Repeated documents come back as often as they
    came in, those with null doc_id too. text_key is a hash of the text. Other columns are
    ignored. No items: all clean; no
    documents: no rows.
    """
    spans = materialize(item_windows(items.select("item_id", "text"), window), "passages")
    sizes = [int(r[0]) for r in spans.select(F.least("length", F.lit(SHINGLE))).distinct().collect()]
    counts = occurrences(docs, shingle_filter(spans), sizes).groupBy("shingle").agg(F.sum("n").alias("n"))
    shingles = spans.select("passage", "length", "shingle", "place").distinct()
    known = shingles.join(counts, "shingle", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarity = Window.partitionBy("passage", "length").orderBy("n", "shingle", "place")
    index = known.withColumn("r", F.row_number().over(rarity)).where("r = 1 AND n > 0")
    index = materialize(index.select("shingle", "place", "passage", "length"), "index")

    seen = materialize(candidates(docs, shingle_filter(index), sizes, window), "candidates")
    rows = seen.where("shingle IS NULL").select("row", "doc_id", "text_key", "n_words")
    near = seen.where("shingle IS NOT NULL").select("row", "shingle", "word", "lead", "near")
    hits = (
        near.join(index, "shingle")
        .where("lead >= place AND size(near) >= lead - place + length")
        .where("concat_ws(' ', slice(near, lead - place + 1, length)) = passage")
        .select("row", (F.col("word") - F.col("place")).alias("first"), "length", "passage")
    )
    hits = materialize(hits, "hits")
    before = Window.partitionBy("row").orderBy("first", "length")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max(F.col("first") + F.col("length")).over(before), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("first") + F.col("length") - F.greatest("first", covered))
    words = hits.withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    named = hits.select("row", "passage").distinct().join(
        spans.select("passage", "item_id").distinct(), "passage"
    )
    texts = F.sort_array(F.collect_set(F.col("item_id").cast("string")))
    named = named.groupBy("row").agg(texts.alias("items"))
    hit = F.coalesce("n_hit", F.lit(0))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return (
        rows.join(words, "row", "left")
        .join(named, "row", "left")
        .select(
            "doc_id",
            "n_words",
            hit.alias("n_hit"),
            F.size(listed).cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"),
            ((hit > 0) & (one_in * hit >= F.col("n_words"))).alias("contaminated"),
            "text_key",
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all columns. See ``contamination``."""
    found = contamination(docs, items).where("contaminated")
    found = found.select("doc_id", "text_key").distinct()
    rows = whole_rows(docs).join(found, same_text(found), "left_anti")
    return rows.select("document.*")
