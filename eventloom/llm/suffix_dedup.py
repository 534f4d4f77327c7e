"""Repeated byte strings across documents, found with suffix arrays of shards."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import (
    as_bytes,
    blocks,
    by_text,
    materialize,
    mix,
    range_hashes,
    shuffle_partitions,
    signed,
)

#: Least length of a repeated string.
LENGTH = 50
#: Bytes of the grams whose least hash names a string.
GRAM = 16
#: Places that one pass names.
PASS = 1 << 14
#: Bytes of a shard's text. Names are decided when a quarter of that has come together.
SHARD_BYTES = 4 << 20
#: More runs of a name in a block of text, or over all, make it hot.
DENSE, HOT_RUNS = 128, 200_000
#: Places that the rows of one text are dealt to.
PLACES = 1024
#: Kinds of packed rows: plain runs, the two that stand for a dense name, its others.
PLAIN, DENSE_ENDS, DENSE_REST = range(3)

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC4CEB9FE1A85EC53)]


def big_words(data: np.ndarray) -> np.ndarray:
    """At each place the next 8 bytes as a number that sorts like them; zeros past the end."""
    n = len(data)
    padded = np.zeros(n + 16, dtype=np.uint8)
    padded[:n] = data
    words = np.empty(n, dtype=np.uint64)
    for r in range(min(8, n)):
        words[r::8] = padded[r : r + 8 * (1 + (n - 1 - r) // 8)].view(">u8")
    return words


def name_runs(data: bytes, offsets: np.ndarray, length: int):
    """(name, text, first place, number) of runs of strings of ``length`` with equal names.

    A string's name is the least hash of the 16-byte grams in it, so equal strings have
    equal names wherever they are, and neighbours mostly share theirs. Places are in ``data``.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    if len(raw) < length:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    least = string_names(raw, length)
    n = len(least)
    # in each text the places where a string fits, then those where none does
    size = np.diff(offsets)
    fits = np.maximum(size - length + 1, 0)
    lengths = np.column_stack([fits, size - fits]).ravel()
    inside = np.repeat(np.tile([True, False], len(size)), lengths)[:n]
    new = np.ones(n, dtype=bool)
    new[1:] = least[1:] != least[:-1]
    new[offsets[offsets < n]] = True
    first = np.flatnonzero(new & inside)
    # a run ends where the next begins, or where no string fits into the text any more
    ends = np.flatnonzero(np.append(new[1:] | ~inside[1:], True) & inside) + 1
    return least[first], np.searchsorted(offsets, first, "right") - 1, first, ends - first


def string_names(raw: np.ndarray, length: int) -> np.ndarray:
    """The least gram hash of the string at each place, in passes that stay in a core's cache."""
    least = np.empty(len(raw) - length + 1, dtype=np.uint64)
    for at in range(0, len(least), PASS):
        words = big_words(raw[at : at + PASS + length - 1])
        n = len(words) - GRAM + 1
        # the words at the gram's front and end hold all its bytes
        hashes = words[GRAM - 8 : GRAM - 8 + n] * _ODD[0]
        hashes ^= hashes >> np.uint64(32)
        hashes += words[:n]
        hashes *= _ODD[1]
        hashes ^= hashes >> np.uint64(29)
        hashes *= _ODD[0]
        grams, have = length - GRAM + 1, 1
        while 2 * have <= grams:
            hashes = np.minimum(hashes[:-have], hashes[have:])
            have *= 2
        if have < grams:
            hashes = np.minimum(hashes[: have - grams], hashes[grams - have :])
        least[at : at + PASS] = hashes
    return least


def suffix_array(
    data: np.ndarray, places: np.ndarray | None = None, most: int | None = None
) -> np.ndarray:
    """Suffixes (those at ``places``) in order (of their first ``most`` bytes).

    Starts from 8 bytes. Each round sorts the suffixes not yet told apart by some bytes more,
    within their groups; a group whose members have the same ``most`` bytes is left as it is.
    """
    n = len(data)
    places = np.arange(n) if places is None else places
    most = max(n if most is None else most, 8)
    if not len(places):
        return places
    words = np.append(big_words(data), np.zeros(most, dtype=np.uint64))
    key = words[places]
    sort = np.argsort(key)
    order, key = places[sort], key[sort]
    new = np.ones(len(order), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    shared, fresh, told = np.arange(len(order)), new, 8
    while True:
        several = ~(fresh & np.append(fresh[1:], True))
        shared, fresh = shared[several], fresh[several]
        if not len(shared):
            break
        own, at, next_ = order[shared], np.flatnonzero(fresh), np.flatnonzero(~fresh)
        differ = np.zeros(len(own), dtype=bool)
        differ[next_] = ~_same(words, own[next_ - 1], own[next_], told, most)
        open_ = np.repeat(np.logical_or.reduceat(differ, at), np.diff(np.append(at, len(own))))
        shared, own, fresh = shared[open_], own[open_], fresh[open_]
        if not len(shared):
            break
        group = np.cumsum(fresh, dtype=np.uint64)
        step = (64 - int(group[-1]).bit_length()) // 8
        key = group << np.uint64(8 * step) | words[own + told] >> np.uint64(64 - 8 * step)
        sort = np.argsort(key)
        order[shared], key = own[sort], key[sort]
        fresh = np.ones(len(own), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        new[shared] = fresh
        told += step
    if places.max() + most > n:
        # what differs by zeros past the end alone: the shorter suffix comes first
        order = order[np.lexsort((-order, np.cumsum(new)))]
    return order


def _same(words: np.ndarray, a: np.ndarray, b: np.ndarray, told: int, most: int) -> np.ndarray:
    """Whether the bytes from ``told`` to ``most`` after places a and b are the same."""
    left = np.arange(len(a))
    for at in (*range(told, most - 8, 8), most - 8) if told < most else ():
        left = left[words[a[left] + at] == words[b[left] + at]]
    same = np.zeros(len(a), dtype=bool)
    same[left] = True
    return same


def common_prefixes(
    data: np.ndarray, order: np.ndarray, starts: np.ndarray, most: int
) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, up to ``most``, by place.

    Neighbours are compared 8 bytes at a time. Parts of the text may begin at ``starts``,
    which makes no difference: common prefixes go on over them.
    """
    n = len(data)
    words = np.append(big_words(data), np.zeros(most, dtype=np.uint64))
    before, own = order[:-1], order[1:]
    have = np.full(len(own), most)
    left = np.arange(len(own))
    for at in range(0, most, 8):
        odd = words[before[left] + at] ^ words[own[left] + at]
        differ = odd != 0
        # leading zero bytes
        equal = [odd[differ] < np.uint64(1 << 8 * (8 - i)) for i in range(1, 8)]
        have[left[differ]] = at + np.sum(equal, axis=0)
        left = left[~differ]
    common = np.zeros(n, dtype=np.int64)
    common[own] = np.minimum(np.minimum(have, most), n - np.maximum(before, own))
    return common


class Shard:
    """The distinct strings of ``length`` bytes in contexts, sorted, with their least document."""

    def __init__(self, contexts: pa.LargeBinaryArray, docs: np.ndarray, length: int):
        self.length = length
        data, size = _joined(contexts)
        starts = np.cumsum(size) - size
        # strings within one context only
        strings = np.maximum(size - length + 1, 0)
        place = np.repeat(starts, strings) + _within(strings)
        self.place = suffix_array(data, place, length)
        common = common_prefixes(data, self.place, starts, length)
        self.group = np.cumsum(common[self.place] < length) - 1
        self.owner = np.repeat(np.arange(len(size)), size)[self.place]
        first = np.flatnonzero(np.diff(self.group, prepend=-1))
        self.least = np.minimum.reduceat(docs[self.owner], first) if len(first) else first
        self.offset = self.place - starts[self.owner]
        self.data, self.first = data, self.place[first]

    def strings(self) -> np.ndarray:
        """The distinct strings, sorted, as one fixed-size value each."""
        rows = self.data[self.first[:, None] + np.arange(self.length)]
        # a byte more than any, so that no trailing zeros are lost
        rows = np.column_stack([rows, np.ones(len(rows), np.uint8)])
        return np.ascontiguousarray(rows).view(f"S{self.length + 1}").ravel()

    def merge(self, other: Shard) -> None:
        """Give equal strings of two shards the least document of both, by binary search."""
        mine, theirs = self.strings(), other.strings()
        at = np.minimum(np.searchsorted(theirs, mine), max(len(theirs) - 1, 0))
        both = np.flatnonzero(theirs[at] == mine) if len(theirs) else np.zeros(0, np.int64)
        least = np.minimum(self.least[both], other.least[at[both]])
        self.least[both], other.least[at[both]] = least, least

    def repeated(self, docs: np.ndarray):
        """(context, offset) of strings that a smaller document has, by context and offset."""
        later = np.flatnonzero(self.least[self.group] < docs[self.owner])
        later = later[np.argsort(self.place[later])]
        return self.owner[later], self.offset[later]


def _joined(contexts: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all contexts, one after the other, and the size of each."""
    ends = np.frombuffer(contexts.buffers()[1], dtype=np.int64)
    ends = ends[contexts.offset : contexts.offset + len(contexts) + 1]
    data = np.frombuffer(contexts.buffers()[2] or b"", dtype=np.uint8)
    return data[ends[0] : ends[-1]], np.diff(ends)


def repeated_strings(contexts: pa.LargeBinaryArray, docs: np.ndarray, length: int):
    """As ``Shard.repeated``, over as many shards as the contexts need."""
    size = np.cumsum(pc.binary_length(contexts).to_numpy())
    cuts = np.searchsorted(size, np.arange(SHARD_BYTES, size[-1], SHARD_BYTES))
    bounds = sorted({0, len(contexts), *cuts.tolist()})
    parts = list(zip(bounds, bounds[1:]))
    shards = [Shard(contexts.slice(a, b - a), docs[a:b], length) for a, b in parts]
    for i in range(len(shards)):
        for j in range(i):
            shards[i].merge(shards[j])
    found = [s.repeated(docs[a:b]) for s, (a, b) in zip(shards, parts)]
    owners = [own + a for (own, _), (a, _) in zip(found, parts)]
    return np.concatenate(owners), np.concatenate([offset for _, offset in found])


def _numbers(batch: pa.RecordBatch, *columns: int) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in columns]


def _spans(*columns) -> pa.RecordBatch:
    names = ["doc", "variant", "start", "stop"]
    return pa.record_batch([pa.array(np.asarray(c, dtype=np.int64)) for c in columns], names)


def _names(length: int, buckets: int):
    """Runs of texts as packed rows, one for each bucket of names and kind.

    Of a name that a block has very often two runs stand for all (``DENSE_ENDS``); the
    others (``DENSE_REST``) need no counting and are dealt anywhere.
    """

    def run(batch):
        docs, variants = _numbers(batch, 0, 1)
        found = [[] for _ in range(4)]  # names, rows, starts, kinds
        for first, _, data, offsets in blocks(batch.column(2)):
            names, text, place, _ = name_runs(data, offsets, length)
            if not len(names):
                continue
            order = np.argsort(names)
            new = np.ones(len(names), dtype=bool)
            new[1:] = names[order[1:]] != names[order[:-1]]
            low = np.flatnonzero(new)
            size = np.diff(np.append(low, len(names)))
            kind = np.zeros(len(names), dtype=np.uint8)
            for at, n in zip(low[size > DENSE].tolist(), size[size > DENSE].tolist()):
                own = order[at : at + n]
                kind[own] = DENSE_REST
                own_docs = docs[first + text[own]]
                kind[own[[own_docs.argmin(), own_docs.argmax()]]] = DENSE_ENDS
            for part, value in zip(found, (names, first + text, place - offsets[text], kind)):
                part.append(value)
        if not found[0]:
            return
        names, rows, starts, kinds = (np.concatenate(part) for part in found)
        bucket = (names >> np.uint64(32)) % np.uint64(buckets)
        rest = kinds == DENSE_REST
        bucket[rest] = mix(starts[rest].astype(np.uint64)) % np.uint64(buckets)
        groups = (bucket * np.uint64(3) + kinds).astype(np.min_scalar_type(3 * buckets))
        order = np.argsort(groups, kind="stable")  # in text order within a group
        cuts = np.flatnonzero(np.diff(groups[order].astype(np.int64))) + 1
        packed = [
            (int(groups[own[0]]) // 3, int(groups[own[0]]) % 3)
            + _pack(names[own], docs[rows[own]], variants[rows[own]], starts[own])
            for own in np.split(order, cuts)
        ]
        types = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
        columns = [pa.array(c, t) for c, t in zip(zip(*packed), types)]
        yield pa.record_batch(columns, ["bucket", "kind", *PACKED])

    return run


PACKED = ["names", "docs", "variants", "counts", "lows", "highs"]


def _pack(names, docs, variants, starts) -> tuple[bytes, ...]:
    """Columns of runs in text order, in few bytes: documents once, as steps, with counts."""
    n = len(names)
    new = np.ones(n, dtype=bool)
    new[1:] = (docs[1:] != docs[:-1]) | (variants[1:] != variants[:-1])
    new |= _within(np.diff(np.append(np.flatnonzero(new), n))) % 255 == 0
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, n)).astype(np.uint8)
    steps = np.diff(docs[at], prepend=np.int64(0)).astype("<i8")
    lows, highs = (starts & 0xFFFF).astype("<u2"), (starts >> 16).astype("<u4")
    if np.array_equal(steps.astype("<i4"), steps):
        steps = steps.astype("<i4")
    parts = (names.astype("<u8"), steps, variants[at].astype("<i8"), counts, lows, highs)
    return tuple(x.tobytes() for x in parts)


def _unpack(row: dict) -> list[np.ndarray]:
    """(names, docs, variants, starts)."""
    counts = np.frombuffer(row["counts"], dtype=np.uint8)
    kind = "<i4" if len(row["docs"]) == 4 * len(counts) else "<i8"
    steps = np.frombuffer(row["docs"], dtype=kind).astype(np.int64)
    docs = np.repeat(np.cumsum(steps), counts)
    variants = np.repeat(np.frombuffer(row["variants"], dtype="<i8"), counts)
    lows = np.frombuffer(row["lows"], dtype="<u2").astype(np.int64)
    highs = np.frombuffer(row["highs"], dtype="<u4").astype(np.int64)
    return [np.frombuffer(row["names"], dtype="<u8"), docs, variants, highs << 16 | lows]


def _wanted(batches):
    """Runs of names that two documents have, from packed rows sorted by bucket.

    Gives (doc, variant, start): where wanted runs of a document start, as -1 - start if
    the name is hot. Holds the runs of one bucket.
    """
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != now and held:
                yield from _repeated_names(held)
                held = []
            now = row["bucket"]
            held.append((row["kind"], *_unpack(row)))
    if held:
        yield from _repeated_names(held)


def _repeated_names(held: list[tuple]):
    kinds = np.concatenate([np.full(len(h[1]), h[0], dtype=np.uint8) for h in held])
    names, docs, variants, starts = (np.concatenate([h[i] for h in held]) for i in range(1, 5))
    rest = kinds == DENSE_REST
    order = np.argsort(names)
    order = order[~rest[order]]
    wanted, hot = rest.copy(), rest.copy()
    if len(order):
        new = np.ones(len(order), dtype=bool)
        new[1:] = names[order[1:]] != names[order[:-1]]
        at, name = np.flatnonzero(new), np.cumsum(new) - 1
        shared = np.minimum.reduceat(docs[order], at) < np.maximum.reduceat(docs[order], at)
        is_hot = np.maximum.reduceat(kinds[order], at) == DENSE_ENDS
        is_hot |= np.diff(np.append(at, len(order))) > HOT_RUNS
        hot[order] = is_hot[name]
        wanted[order] = (shared | is_hot)[name]
    docs, variants = docs[wanted], variants[wanted]
    starts = np.where(hot[wanted], -1 - starts[wanted], starts[wanted])
    if not len(docs):
        return
    columns = [pa.array(docs), pa.array(variants), pa.array(starts.astype(np.int32))]
    yield pa.record_batch(columns, ["doc", "variant", "start"])


def _contexts(length: int):
    """The wanted runs with their bytes, and spans already decided (no bytes).

    A run that is a copy of one of a smaller document in the same block is decided. Runs of
    hot names, wanted as -1 - start, are cut into single strings, each named by itself.
    """

    def run(batch):
        docs, variants = _numbers(batch, 0, 1)
        wanted = batch.column(3)
        for first, end, data, offsets in blocks(batch.column(2)):
            names, text, place, count = name_runs(data, offsets, length)
            part = wanted.slice(first, end - first)
            sizes = np.diff(np.concatenate(([0], np.cumsum([len(x) for x in part]))))
            starts = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            hot = starts < 0
            starts = np.where(hot, -1 - starts, starts) + np.repeat(offsets[:-1], sizes)
            take = np.flatnonzero(np.isin(place, starts))
            names, text, place, count = names[take], text[take], place[take], count[take]
            hot = np.isin(place, starts[hot])
            stop = place + count + length - 1
            doc, variant = docs[first + text], variants[first + text]
            contexts = [data[a:b] for a, b in zip(place.tolist(), stop.tolist())]
            least: dict[bytes, int] = {}
            copy = np.zeros(len(contexts), dtype=bool)
            own = doc.tolist()
            for i in np.argsort(doc, kind="stable").tolist():
                copy[i] = least.setdefault(contexts[i], own[i]) < own[i]
            base = offsets[text]
            if copy.any():
                # these need no comparing and go anywhere
                yield _runs(
                    mix(place[copy].astype(np.uint64) ^ names[copy]),
                    [x[copy] for x in (doc, variant, place - base, stop - base)],
                    [None] * int(copy.sum()),
                )
            plain = ~copy & ~hot
            if plain.any():
                yield _runs(
                    names[plain],
                    [x[plain] for x in (doc, variant, place - base)],
                    [contexts[i] for i in np.flatnonzero(plain).tolist()],
                )
            split = np.flatnonzero(~copy & hot)
            if len(split):
                which = np.repeat(split, count[split])
                at = place[which] + _within(count[split])
                raw = np.frombuffer(data, dtype=np.uint8)
                yield _runs(
                    range_hashes(raw, at, at + length),
                    [doc[which], variant[which], at - base[which]],
                    [data[a : a + length] for a in at.tolist()],
                )

    return run


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _runs(names: np.ndarray, numbers: list[np.ndarray], contexts: list) -> pa.RecordBatch:
    """Rows of runs; those with a context end where it does and need no stop."""
    columns = [pa.array(signed(names)), *[pa.array(x) for x in numbers]]
    if len(numbers) == 3:
        columns.append(pa.nulls(len(names), pa.int64()))
    columns.append(pa.array(contexts, pa.binary()))
    return pa.record_batch(columns, ["name", "doc", "variant", "start", "stop", "context"])


def _compare(length: int):
    """Streams runs sorted by (name, context, doc): the spans that smaller documents have."""

    def run(batches):
        held, size = [], 0
        before = (None, None, 0)  # name, context and least document of the last run
        for batch in batches:
            if not batch.num_rows:
                continue
            names, docs, variants, starts = _numbers(batch, 0, 1, 2, 3)
            contexts = batch.column(5).cast(pa.large_binary())
            bare = contexts.is_null().to_numpy(zero_copy_only=False)
            size_of = pc.binary_length(contexts).fill_null(0).to_numpy()
            stops = np.where(bare, batch.column(4).fill_null(0).to_numpy(), starts + size_of)
            # equal runs are neighbours, the least document first
            new = np.ones(len(names), dtype=bool)
            equal = pc.equal(contexts[1:], contexts[:-1]).fill_null(False)
            new[1:] = (names[1:] != names[:-1]) | ~equal.to_numpy(zero_copy_only=False)
            at = np.flatnonzero(new)
            least = docs[at]
            if before[0] == names[0] and before[1] is not None and before[1] == contexts[0].as_py():
                least[0] = before[2]
            before = (names[-1], contexts[-1].as_py(), least[-1])
            copy = bare | (docs > np.repeat(least, np.diff(np.append(at, len(names)))))
            if copy.any():
                yield _spans(docs[copy], variants[copy], starts[copy], stops[copy])
            left = np.flatnonzero(~copy)
            if not len(left):
                continue
            kept = contexts.take(pa.array(left))
            held.append(([x[left] for x in (names, docs, variants, starts)], kept))
            size += int(size_of[left].sum())
            if size > SHARD_BYTES // 4:
                held, decided = _settle(held, length, False)
                size = sum(pc.sum(pc.binary_length(own)).as_py() or 0 for _, own in held)
                yield from decided
        if held:
            yield from _settle(held, length, True)[1]

    return run


def _settle(held: list, length: int, last: bool):
    """(what is still open, spans): decides all names that can get no more runs."""
    columns = [np.concatenate([x[i] for x, _ in held]) for i in range(4)]
    contexts = pa.concat_arrays([own for _, own in held])
    cut = len(contexts) if last else int(np.searchsorted(columns[0], columns[0][-1]))
    decided = list(_decide(*(c[:cut] for c in columns), contexts[:cut], length)) if cut else []
    return [([c[cut:] for c in columns], contexts[cut:])], decided


def _decide(names, docs, variants, starts, contexts, length: int):
    """Spans of runs, of which no two of one name are copies unless of one document."""
    n = len(names)
    edge = np.ones(n, dtype=bool)
    edge[1:] = names[1:] != names[:-1]
    name, at = np.cumsum(edge) - 1, np.flatnonzero(edge)
    several = np.minimum.reduceat(docs, at) < np.maximum.reduceat(docs, at)
    chosen = np.flatnonzero(several[name])
    if not len(chosen):
        return
    # strings of different names differ, so one search serves all names
    docs, variants, starts = docs[chosen], variants[chosen], starts[chosen]
    owner, offset = repeated_strings(contexts.take(pa.array(chosen)), docs, length)
    if not len(owner):
        return
    begin = np.ones(len(owner), dtype=bool)
    begin[1:] = (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)
    first = np.flatnonzero(begin)
    stop = offset[np.append(first[1:], len(owner)) - 1] + length
    owner, offset = owner[first], offset[first]
    yield _spans(docs[owner], variants[owner], starts[owner] + offset, starts[owner] + stop)


def copies(texts: DataFrame, length: int) -> DataFrame:
    """(doc, variant, n_bytes) of texts of ``length`` or more that a smaller doc has whole.

    Rows of one text are dealt to at most ``PLACES`` places by doc and the task that reads
    them. The least doc of each place goes to the text, the least of all back to the places
    that exist, so no task meets all rows of a text.
    """
    place = F.pmod(F.xxhash64("doc") + F.spark_partition_id(), F.lit(PLACES)).cast("int")
    keyed = texts.where(F.octet_length("text") >= length).select(
        "doc",
        "variant",
        F.unhex(F.sha2("text", 256)).alias("key"),
        place.alias("place"),
        F.octet_length("text").alias("n_bytes"),
    )
    keyed = materialize(keyed, "keys")  # a row's place must be the same whenever it is read
    parts = keyed.groupBy("key", "place").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    whole = parts.groupBy("key").agg(
        F.min("least").alias("least"), F.max("most").alias("most"), F.collect_list("place").alias("places")
    )
    least = whole.where("least < most").select("key", "least", F.explode("places").alias("place"))
    return keyed.join(least, ["key", "place"]).where("doc > least").select("doc", "variant", "n_bytes")


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, variant, start, stop): bytes of texts (doc, variant, text) that smaller docs have.

    Spans may overlap. See ``remove_repeats``.
    """
    partitions = shuffle_partitions(texts)
    binaries = ", ".join(f"{name} binary" for name in PACKED)
    names = by_text(_names(length, partitions), texts, f"bucket int, kind int, {binaries}")
    names = names.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    wanted = names.mapInArrow(_wanted, "doc long, variant long, start int")
    wanted = wanted.groupBy("doc", "variant").agg(F.collect_list("start").alias("starts"))
    rows = texts.join(wanted, ["doc", "variant"]).select("doc", "variant", "text", "starts")
    schema = "name long, doc long, variant long, start long, stop long, context binary"
    runs = by_text(_contexts(length), rows, schema)
    runs = runs.repartition(partitions, "name")
    runs = runs.sortWithinPartitions("name", "context", "doc")
    return runs.mapInArrow(_compare(length), "doc long, variant long, start long, stop long")


def _cut(keep_text: bool):
    def run(batch):
        texts = as_bytes(batch.column(1)).to_pylist()
        rows = []
        for text, spans in zip(texts, batch.column(2).to_pylist()):
            parts, removed, count, done = [], 0, 0, -1
            at = 0
            for span in sorted((s["start"], s["stop"]) for s in spans or ()):
                if span[0] > done:
                    parts.append(text[at : span[0]])
                    count += 1
                    at, done = span
                    removed += done - at
                elif span[1] > done:
                    removed += span[1] - done
                    done = span[1]
                at = done
            kept = b"".join([*parts, text[at:]])
            digest = hashlib.sha256(kept).hexdigest()
            rows.append((len(text), removed, count, digest, kept if keep_text else None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        yield pa.record_batch([batch.column(0), *columns], names)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row of documents.

    Removed is each byte in a string of ``length`` bytes that also starts in a document with
    a smaller doc_id; n_spans counts the maximal removed runs, kept has the other bytes (if
    asked for; they may cut a character).

    Of equal texts only the one of least doc_id goes on: all strings of the others start in
    it, and it stands for them. Every string has a name, the least hash of the 16-byte grams
    in it, and neighbouring strings with one name are a run, some 18 strings in 67 bytes.
    Names that only one document has need no more. The runs of the others meet by name in
    shards. A shard drops copies and sorts the suffixes of the different runs by ``length``
    bytes, only those that begin a string. Neighbours with common prefixes of ``length`` are
    equal strings. Runs of one name that fill several shards are merged by binary search in
    the sorted strings. A name that a block of text has over 128 times, or that has over
    200 000 runs, is hot: its runs are cut into single strings that are dealt by their own
    hash. Copies within a block of 1 MiB are decided there. A task holds a block of text, or
    the packed names of one bucket (the runs by the number of shuffle partitions, so set that
    by the input's size), or the different runs of one name that is not hot.

    Null text counts as empty. Rows with null doc_id count as larger than all others and
    equal among themselves. Rows with equal doc_id never count as smaller than each other
    and come back as often as they came in. Other columns are ignored; no documents give no
    rows.
    """
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} or more")
    last = F.lit((1 << 63) - 1)
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), last).alias("doc"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    repeated = texts.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1")
    # zero, but no constant, which would make the columns of the exchanged texts differ
    variant = F.expr("doc & 0L") if repeated.isEmpty() else F.xxhash64("text")
    texts = texts.select("doc", variant.alias("variant"), "text")
    keys = ["doc", "variant"]
    whole = materialize(copies(texts, length), "copies")
    # the joins with what is wanted and what goes read one exchange of these texts
    others = texts.join(whole.select(*keys).distinct(), keys, "left_anti")
    spans = repeated_spans(others, length).groupBy(*keys)
    spans = spans.agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    doc_id = F.nullif("doc", last).alias("doc_id")
    rows = others.join(spans, keys, "left").select(doc_id, "text", "spans")
    schema = (
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    size, nothing = F.col("n_bytes").cast("long"), F.lit(b"")
    gone = whole.select(
        doc_id,
        size.alias("n_bytes"),
        size.alias("n_removed"),
        F.lit(1).cast("long").alias("n_spans"),
        F.sha2(nothing, 256).alias("kept_sha256"),
        (nothing if keep_text else F.lit(None).cast("binary")).alias("kept"),
    )
    return by_text(_cut(keep_text), rows, schema).unionByName(gone)
