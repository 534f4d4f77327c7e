"""Licence notices in files: positional index of rare licence words."""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import blocks, by_text, find_words, signed
from eventloom.llm.notices import HOLDS, NOTICES

# Phrases whose every place counts, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Label, mandatory key phrase and text of public licence notices.
TEMPLATES = [
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    ("gpl-2.0", "gnu general public license version 2", "licensed under the gnu general public license version 2"),
    ("gpl-3.0", "gnu general public license version 3", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license", "under the terms of the gnu lesser general public license"),
    ("agpl-3.0", "gnu affero general public license", "under the terms of the gnu affero general public license version 3"),
    ("cc-by-4.0", "cc by 4 0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "licensed under cc by nc 4 0"),
    ("mit-notice", "under the mit license", "released under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
]

#: A template is found if so large a part of its words is in place.
COVERAGE = 0.6

#: A whole notice is found if its words in order carry so large a part of its weight.
NOTICE_COVERAGE = 0.7


def word_hashes(words: list[str]) -> np.ndarray:
    data = "\n".join(words).encode()
    return find_words(data, np.array([0, len(data)]))[3]


def slack(distance):
    """How far two phrases may stand from their distance in a notice, for words put in or left out."""
    return 12 + distance // 4


class Words:
    """A fixed set of word hashes and the places where texts have them."""

    def __init__(self, hashes):
        self.sorted = np.unique(np.array(list(hashes), dtype=np.int64).view(np.uint64))
        self.some = np.zeros(1 << 16, dtype=bool)
        self.some[self.sorted >> np.uint64(48)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, number of the word in the set)"""
        near = np.flatnonzero(self.some[hashes >> np.uint64(48)])
        at = np.minimum(np.searchsorted(self.sorted, hashes[near]), len(self.sorted) - 1)
        real = self.sorted[at] == hashes[near]
        return near[real], at[real]


class Notice:
    """A licence notice: weighted words, key phrases by place, the one with the rarest word first."""

    def __init__(self, label: str, keys: list[str], text: str, idf):
        self.label, self.words = label, word_hashes(text.split())
        self.weights = np.array([1 + idf(m) for m in signed(self.words).tolist()])
        self.total = float(self.weights.sum())
        phrases = []  # (idf of the rarest word, its place in the phrase, place, end)
        for key in keys:
            wanted = word_hashes(key.split())
            places = range(len(self.words) - len(wanted) + 1)
            first = next(i for i in places if np.array_equal(self.words[i : i + len(wanted)], wanted))
            own = [idf(m) for m in signed(wanted).tolist()]
            rarest = max(range(len(own)), key=own.__getitem__)
            phrases.append((own[rarest], rarest, first, first + len(wanted)))
        self.phrases = sorted(phrases, key=lambda p: -p[0])
        self.marks = [signed(self.words[f + r : f + r + 1]).tolist()[0] for _, r, f, _ in self.phrases]

    def _full(self, hashes: np.ndarray, places: np.ndarray, phrase) -> np.ndarray:
        """Starts of whole phrases, from the places of their rarest word."""
        _, rarest, first, end = phrase
        starts = places - rarest
        starts = starts[(starts >= 0) & (starts + end - first <= len(hashes))]
        for j in range(end - first):
            starts = starts[hashes[starts + j] == self.words[first + j]]
        return starts

    def candidates(self, hashes: np.ndarray, places: dict[int, np.ndarray]) -> np.ndarray:
        """Starts of the first key phrase that have all others about where the notice has them."""
        if not all(m in places for m in self.marks):
            return np.zeros(0, dtype=np.int64)
        starts = self._full(hashes, places[self.marks[0]], self.phrases[0])
        for mark, phrase in zip(self.marks[1:], self.phrases[1:]):
            others = self._full(hashes, places[mark], phrase)
            apart = phrase[2] - self.phrases[0][2]
            low = np.searchsorted(others, starts + apart - slack(abs(apart)))
            high = np.searchsorted(others, starts + apart + slack(abs(apart)), "right")
            starts = starts[high > low]
        return starts

    def window(self, start: int, n: int) -> tuple[int, int]:
        before = self.phrases[0][2]
        after = len(self.words) - before
        return max(0, start - before - slack(before)), min(n, start + after + slack(after))

    def bound(self, words: np.ndarray) -> float:
        """At least ``aligned``."""
        return float(self.weights[np.isin(self.words, words)].sum()) / self.total

    def aligned(self, words: np.ndarray) -> float:
        """Largest part of the weight on words that both have in the same order."""
        best = np.zeros(len(words) + 1)
        for word, weight in zip(self.words, self.weights):
            best[1:] = np.maximum(best[1:], best[:-1] + weight * (words == word))
            np.maximum.accumulate(best, out=best)
        return float(best[-1]) / self.total


class NoticeIndex:
    """Postings from the rarest word of every key phrase to the notices that have it."""

    def __init__(self, counts: dict[int, int], documents: int):
        def idf(mark: int) -> float:
            return math.log((1 + documents) / (1 + counts.get(mark, 0)))

        self.notices = [Notice(*n, idf) for n in NOTICES]
        self.by_mark: dict[int, list[Notice]] = {}  # by the rarest mark of each notice
        for notice in self.notices:
            self.by_mark.setdefault(notice.marks[0], []).append(notice)
        self.idf = {m: idf(m) for n in self.notices for m in n.marks}
        self.words = Words(self.idf)
        #: Words without which a file has no notice.
        self.needed = np.isin(signed(self.words.sorted), list(self.by_mark))

    def scan(self, hashes: np.ndarray, places: np.ndarray, which: np.ndarray) -> dict[str, float]:
        """{label: part in place} of a file, from the places of its licence words, rarest first."""
        order = np.argsort(which, kind="stable")
        names, first = np.unique(which[order], return_index=True)
        marks = signed(self.words.sorted[names]).tolist()
        at = dict(zip(marks, np.split(places[order], first[1:])))
        best: dict[str, float] = {}
        found: dict[str, list[tuple[int, int]]] = {n: [] for pair in HOLDS.items() for n in pair}
        for mark in sorted(at, key=lambda m: (-self.idf[m], m)):
            for notice in self.by_mark.get(mark, ()):
                label = notice.label
                for start in notice.candidates(hashes, at).tolist():
                    low, high = notice.window(start, len(hashes))
                    here = hashes[low:high]
                    if label not in found and notice.bound(here) <= best.get(label, 0.0):
                        continue
                    part = notice.aligned(here)
                    if part < NOTICE_COVERAGE:
                        continue
                    best[label] = max(part, best.get(label, 0.0))
                    if label in found:
                        found[label].append((start, start + len(notice.words) - notice.phrases[0][2]))
        for longer, shorter in HOLDS.items():
            if found[longer] and all(_overlap(found[longer], *own) for own in found[shorter]):
                best.pop(shorter, None)
        return best


def _overlap(ranges: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of the ascending ranges of equal length meets [start, end)."""
    at = bisect_left(ranges, (end,)) - 1
    return at >= 0 and ranges[at][1] > start


class LicenceIndex:
    """Postings (template, position) of the words a template can be recognised by."""

    def __init__(self, counts: dict[int, int], documents: int):
        def idf(mark: int) -> float:
            return math.log((1 + documents) / (1 + counts.get(mark, 0)))

        self.entries = []  # (label, is phrase, hashes of the words, key phrase from, to)
        for phrase, label in PHRASES.items():
            words = word_hashes(phrase.split())
            self.entries.append((label, True, words, 0, len(words)))
        for label, key, text in TEMPLATES:
            words, wanted = word_hashes(text.split()), word_hashes(key.split())
            at = next(
                i for i in range(len(words)) if words[i : i + len(wanted)].tolist() == wanted.tolist()
            )
            self.entries.append((label, False, words, at, at + len(wanted)))
        self.idf: dict[int, float] = {}
        self.postings: dict[int, list[tuple[int, int]]] = {}
        # the rarest word of a key phrase: where a template is, it is
        self.marks: set[int] = set()
        for n, (_, _, words, first, end) in enumerate(self.entries):
            marks = signed(words).tolist()
            rarest = max(marks[first:end], key=lambda m: (idf(m), m))
            self.marks.add(rarest)
            for place, mark in enumerate(marks):
                self.idf[mark] = idf(mark)
                self.postings.setdefault(mark, []).append((n, place))
        self.sorted = np.sort(np.array(list(self.marks), dtype=np.int64).view(np.uint64))
        self.some = np.zeros(1 << 16, dtype=bool)
        self.some[self.sorted >> np.uint64(48)] = True

    def rare_places(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words that are the rarest of some key phrase."""
        near = np.flatnonzero(self.some[hashes >> np.uint64(48)])
        at = np.minimum(np.searchsorted(self.sorted, hashes[near]), len(self.sorted) - 1)
        return near[self.sorted[at] == hashes[near]]

    def scan(self, hashes: np.ndarray, places: np.ndarray):
        """(phrase places, labels of phrases, labels of templates, best coverage) of a file."""
        marks = signed(hashes[places]).tolist()
        base, labels, found, best = [], set(), set(), 0.0
        tried = set()
        for place, mark in zip(places.tolist(), marks):
            for n, own in self.postings[mark]:
                label, phrase, words, first, end = self.entries[n]
                start = place - own
                if (n, start) in tried:
                    continue
                tried.add((n, start))
                if start + first < 0 or start + end > len(hashes):
                    continue
                if not np.array_equal(hashes[start + first : start + end], words[first:end]):
                    continue
                if phrase:
                    base.append(start)
                    labels.add(label)
                    best = 1.0
                    continue
                a, b = max(0, start), min(len(hashes), start + len(words))
                same = int((hashes[a:b] == words[a - start : b - start]).sum())
                if same >= COVERAGE * len(words):
                    found.add(label)
                    best = max(best, same / len(words))
        return base, labels, found, best


def licence_word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): documents that hold each word of the index, over all documents."""
    texts = [*PHRASES, *(t[2] for t in TEMPLATES), *(n[2] for n in NOTICES)]
    words = Words(signed(word_hashes(sorted({w for t in texts for w in t.split()}))))
    known = words.sorted

    def run(batch):
        for first, end, data, offsets in blocks(batch.column(0)):
            _, _, _, hashes, at = find_words(data, offsets)
            places, which = words.find(hashes)
            owner = np.searchsorted(at, places, "right") - 1
            pairs = np.unique(owner * len(known) + which)
            word, n = np.unique(pairs % len(known), return_counts=True)
            yield pa.record_batch([pa.array(signed(known[word])), pa.array(n)], ["word", "n"])

    return by_text(run, docs.select("text"), "word long, n long").groupBy("word").agg(
        F.sum("n").alias("n")
    )


def _by_file(at: np.ndarray, places: np.ndarray):
    """(file, its places from its first word on) of the files that have any."""
    owner = np.searchsorted(at, places, "right") - 1
    files, first = np.unique(owner, return_index=True)
    for i, own in zip(files.tolist(), np.split(places, first[1:])):
        yield i, own - at[i]


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per document.

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased.
    The inverse document frequency (idf) of every licence word comes from all documents.

    Statements (``PHRASES``, ``TEMPLATES``): the index has the rarest word of every key
    phrase, so every full place of one is found. A posting says where the template would
    start; its key phrase must stand there word for word and 60 % of its words in place.
    ``PHRASES`` are all key phrase: n_base counts their places, first_word and last_word are
    the least and greatest start.

    Whole notices (``NOTICES``): a file's licence words are looked up from the rarest on.
    Each place of the key phrase with the notice's rarest word is a candidate if all other
    key phrases stand about where the notice has them, give or take ``slack`` of the
    distance. Then the words that notice and window have in the same order must carry 70 %
    of the notice's weight, 1 + idf a word; so words may be put in, left out or changed.
    A notice inside a longer one that holds it (``HOLDS``) is not named.

    Words are compared by 64-bit hashes. score: the largest part of a template or notice in
    place, 1 with a phrase, 0 without any. Labels are distinct, sorted, comma-joined.

    Null, empty and wordless texts have no words, no labels, null places and score 0.
    Repeated rows and null doc_ids come back as they are. Other columns are ignored; no
    documents give no rows. Memory: a block of 1 MiB of text or one longer text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = {r.word: r.n for r in licence_word_counts(docs).collect()}  # at most the index's words
    n_docs = docs.count()
    index, notices = LicenceIndex(counts, n_docs), NoticeIndex(counts, n_docs)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word"]
    names += ["base_labels", "labels", "score"]

    def run(batch):
        ids = batch.column(0)
        for first, end, data, offsets in blocks(batch.column(1)):
            _, _, _, hashes, at = find_words(data, offsets)
            n = end - first
            n_base, score = np.zeros(n, dtype=np.int64), np.zeros(n)
            lowest, highest = [None] * n, [None] * n
            base_labels, labels = [""] * n, [set() for _ in range(n)]
            for i, own in _by_file(at, index.rare_places(hashes)):
                base, named, found, best = index.scan(hashes[at[i] : at[i + 1]], own)
                n_base[i], score[i] = len(base), best
                base_labels[i] = ",".join(sorted(named))
                labels[i] |= named | found
                if base:
                    lowest[i], highest[i] = min(base), max(base)
            places, which = notices.words.find(hashes)
            some = np.zeros(n, dtype=bool)
            some[np.searchsorted(at, places[notices.needed[which]], "right") - 1] = True
            kept = some[np.searchsorted(at, places, "right") - 1]
            places, which = places[kept], which[kept]
            done = 0
            for i, own in _by_file(at, places):
                found = notices.scan(hashes[at[i] : at[i + 1]], own, which[done : done + len(own)])
                done += len(own)
                labels[i].update(found)
                score[i] = max(score[i], *found.values(), 0.0)
            labels = [",".join(sorted(own)) for own in labels]
            columns = [ids.slice(first, n), np.diff(at), n_base]
            columns += [pa.array(lowest, pa.int64()), pa.array(highest, pa.int64())]
            columns += [base_labels, labels, score]
            yield pa.record_batch([pa.array(c) if not isinstance(c, pa.Array) else c for c in columns], names)

    return by_text(
        run,
        docs,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double",
    )
