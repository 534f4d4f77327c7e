"""Packing of token sequences into fixed windows: bounded-space online best fit."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import materialize

WINDOW = 4096
OPEN_WINDOWS = 32
#: Left-over windows of so many partitions (or groups) are merged by one task.
MERGED = 256
#: Newest runs of letters or signs whose ids a worker keeps, and as many older ones.
CACHED_RUNS = 400_000
#: Texts encoded at once: so many, or so many characters.
TEXTS, CHARACTERS = 256, 1 << 20
_WIDTH = 4  # bytes of a token id


class Memory:
    """What was learned lately: the newest ``most`` entries, and as many before them."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def learn(self, keys, teach: Callable[[list], list]) -> bool:
        """Makes ``new`` hold the keys; true if it has only these now."""
        full = len(self.new) > self.most
        if full:
            self.new, self.old = {}, self.new
        unknown = []
        for key in keys:
            value = self.old.get(key)
            if value is None:
                unknown.append(key)
            else:
                self.new[key] = value
        self.new.update(zip(unknown, teach(unknown)))
        return full


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself, if it shows."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    """Token ids of texts as little-endian 32-bit bytes, encoding each distinct run once.

    For byte-level tokenizers that drop white space and split the rest into runs of letters,
    single digits, runs of other signs and contractions, after NFC and lower-casing: the
    ids of a text are those of its runs one after the other. Words with other than Latin
    letters, or a special token, go to the tokenizer whole.
    """

    # The runs such tokenizers make, and characters that NFC leaves alone and
    # whose classes are the same everywhere.
    RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
    PLAIN = re.compile(r"[ \t\n\r!-~\u00a1-\u00ac\u00ae-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u024f]*")
    BLANK = re.compile(r"[ \t\n\r]+")

    def __init__(self, path: str, end_id: int | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.end = b"" if end_id is None else array("I", [end_id]).tobytes()
        self.known = Memory(CACHED_RUNS)

    def _encode(self, runs: list[str]) -> list[bytes]:
        found = []
        for run in runs:
            if self.PLAIN.fullmatch(run) and "<|" not in run:
                # already what the model sees, but for the letters that stand for its bytes
                letters = run.encode().decode("latin-1").translate(self.letters)
                ids = [t.id for t in self.model.tokenize(letters)]
            else:
                ids = self.tokenizer.encode(run, add_special_tokens=False).ids
            found.append(array("I", ids).tobytes())
        return found

    def _split(self, text: str) -> list[str]:
        if "<|" not in text and self.PLAIN.fullmatch(text):
            return self.RUNS.findall(text.lower())
        parts = []
        for word in self.BLANK.split(text):
            plain = "<|" not in word and self.PLAIN.fullmatch(word)
            parts += self.RUNS.findall(word.lower()) if plain else [word]
        return parts

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [self._split(t) for t in texts]
        known = self.known.new
        new = set().union(*split).difference(known)
        if new:
            if self.known.learn(new, self._encode):  # it has begun anew
                new = set().union(*split).difference(self.known.new)
                self.known.learn(new, self._encode)
            known = self.known.new
        return [b"".join([known[p] for p in parts]) + self.end for parts in split]


class Piece:
    """A run of a document's ids: ``ids[first:]``, so that no cut copies what follows."""

    __slots__ = ("doc_id", "start", "ids", "first", "doc_tokens")

    def __init__(self, doc_id, start: int, ids: bytes, doc_tokens: int, first: int = 0):
        self.doc_id, self.start, self.ids, self.doc_tokens = doc_id, start, ids, doc_tokens
        self.first = first

    def __len__(self) -> int:
        return len(self.ids) // _WIDTH - self.first

    def cut(self, length: int) -> tuple[Piece, Piece]:
        """A head with ids of its own, so that it does not hold the document, and the rest."""
        stop = self.first + length
        head = self.ids[self.first * _WIDTH : stop * _WIDTH]
        return (
            Piece(self.doc_id, self.start, head, self.doc_tokens),
            Piece(self.doc_id, self.start + length, self.ids, self.doc_tokens, stop),
        )


def best_fit(pieces: Iterator[Piece], window: int, open_windows: int) -> Iterator[list[Piece]]:
    """Full windows, as they fill up; then what is left in the open ones.

    A piece goes to the open window with the least room that holds it. If none does, a
    window is opened; once ``open_windows`` are, the fullest is filled with the piece's head
    and leaves, and its tail is placed in turn. So only the last windows are not full.
    """
    rooms: list[tuple[int, int]] = []  # (room, name) of the open windows, ascending
    content: dict[int, list[Piece]] = {}
    name = 0
    for piece in pieces:
        while len(piece):
            if len(piece) >= window:
                head, piece = piece.cut(window)
                yield [head]
                continue
            at = bisect_left(rooms, (len(piece), -1))
            if at < len(rooms):
                room, own = rooms.pop(at)
                head, piece = piece.cut(len(piece))
            elif len(rooms) < open_windows:
                name += 1
                room, own, content[name] = window, name, []
                head, piece = piece.cut(len(piece))
            else:
                room, own = rooms.pop(0)
                head, piece = piece.cut(room)
            content[own].append(head)
            if room == len(head):
                yield content.pop(own)
            else:
                insort(rooms, (room - len(head), own))
    yield from (content[own] for _, own in rooms)


def refill(windows: Iterator[list[Piece]], window: int) -> Iterator[list[Piece]]:
    """The same pieces in order, cut where a window is full; the last may be short."""
    now, room = [], window
    for piece in (p for w in windows for p in w):
        while len(piece):
            head, piece = piece.cut(min(room, len(piece)))
            now.append(head)
            room -= len(head)
            if not room:
                yield now
                now, room = [], window
    if now:
        yield now


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, place int, grp long, ids binary"
)


def _rows(windows: Iterator[list[Piece]], window: int, group: int, base: int, last: bool):
    """Rows of the windows; a short one keeps its ids for the next merge unless it is the last."""
    n = 0
    for content in windows:
        full = sum(map(len, content)) == window
        offset = 0
        for place, p in enumerate(content):
            done = full or last
            yield (
                p.doc_id,
                p.start,
                len(p),
                zlib.crc32(p.ids),
                p.doc_tokens,
                base + n if done else None,
                offset,
                place,
                group,
                None if done else p.ids,
            )
            offset += len(p)
        n += 1


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.binary()]
    names = [*COLUMNS, "place", "grp", "ids"]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def _portions(batch: pa.RecordBatch):
    keys, texts, size = [], [], 0
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        text = text.as_py() or ""
        keys.append(key)
        texts.append(text)
        size += len(text)
        if len(keys) == TEXTS or size > CHARACTERS:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def pack(
    docs: DataFrame,
    encoder: Callable[[], Callable[[list[str]], list[bytes]]],
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
) -> DataFrame:
    """Pieces of documents (doc_id, text) packed into sequences of at most ``window`` ids.

    Each partition packs what it reads, holding ``open_windows`` windows; then it joins its
    open windows to full ones, and its one short window goes on. Short windows of 256
    partitions are joined by one task, those of 256 such groups by the next, until one is
    left: all sequences but that one are full. One row per piece: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id (unique, not gapless), offset. Null text counts as
    empty: whatever the encoder gives for that, no ids then no piece. Repeated rows and rows
    with a null doc_id are packed like others. Other columns are ignored; no documents give
    no rows. Memory: one text and the open windows.
    """

    def run(batches):
        encode, group = encoder(), TaskContext.get().partitionId()

        def pieces():
            for batch in batches:
                for keys, texts in _portions(batch):
                    for key, ids in zip(keys, encode(texts)):
                        yield Piece(key, 0, ids, len(ids) // _WIDTH)

        def windows():
            short = []
            for content in best_fit(pieces(), window, open_windows):
                if sum(map(len, content)) == window:
                    yield content
                else:
                    short.append(content)
            yield from refill(iter(short), window)

        rows = []
        for row in _rows(windows(), window, group, group << 32, False):
            rows.append(row)
            if len(rows) == 8192:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    columns = [F.col("doc_id").cast("long").alias("doc_id"), "text"]
    packed = materialize(docs.select(*columns).mapInArrow(run, SCHEMA), "packed")
    done = packed.where("ids IS NULL").select(*COLUMNS)
    short, level = packed.where("ids IS NOT NULL"), 0
    while not short.isEmpty():
        level += 1
        last = short.agg(F.max("grp")).first()[0] < MERGED
        merge = _merge(window, level << 56, last)
        merged = short.withColumn("next", F.expr(f"grp div {MERGED}"))
        merged = materialize(merged.groupBy("next").applyInPandas(merge, SCHEMA), "merged")
        done = done.unionByName(merged.where("ids IS NULL").select(*COLUMNS))
        short = merged.where("ids IS NOT NULL")
    return done


def _merge(window: int, base: int, last: bool):
    def run(key, frame):
        group = int(key[0])
        frame = frame.sort_values(["grp", "place"])
        pieces = [
            Piece(None if pd.isna(d) else int(d), int(s), bytes(i), int(n))
            for d, s, i, n in zip(frame.doc_id, frame.start, frame.ids, frame.doc_tokens)
        ]
        rows = list(_rows(refill(iter([pieces]), window), window, group, base + (group << 32), last))
        return pd.DataFrame(rows, columns=[*COLUMNS, "place", "grp", "ids"]).astype(
            {"doc_id": "Int64", "sequence_id": "Int64"}
        )

    return run
