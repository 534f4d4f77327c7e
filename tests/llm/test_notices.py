import math
import random

import pytest

from eventloom.llm import licenses
from eventloom.llm.common import signed
from eventloom.llm.licenses import NOTICE_COVERAGE, NoticeIndex, license_scan, slack, word_hashes
from eventloom.llm.notices import HOLDS, NOTICES
from tests.llm import fixtures
from tests.llm.test_licenses import tokens


def common_part(weights, words, text):
    """Weight of the heaviest common subsequence, cell by cell."""
    best = [0.0] * (len(text) + 1)
    for word, weight in zip(words, weights):
        above = best[:]
        for j, other in enumerate(text):
            best[j + 1] = max(above[j + 1], best[j], above[j] + weight if word == other else 0.0)
    return best[-1] / sum(weights)


def slow(text, idf):
    """{label: part} with every place of every key phrase tried."""
    best, found = {}, {}
    for label, keys, notice in NOTICES:
        words = notice.split()

        def starts(key, own):
            return [i for i in range(len(own) - len(key) + 1) if own[i : i + len(key)] == key]

        phrases = [(max(map(idf, k.split())), starts(k.split(), words)[0], k.split()) for k in keys]
        _, anchor, key = max(phrases, key=lambda p: p[0])
        for s in starts(key, text):
            def stands(at, other):
                wide = slack(abs(at - anchor))
                return any(abs(o - s - (at - anchor)) <= wide for o in starts(other, text))

            if not all(stands(at, other) for _, at, other in phrases):
                continue
            low = max(0, s - anchor - slack(anchor))
            high = s + len(words) - anchor + slack(len(words) - anchor)
            part = common_part([1 + idf(w) for w in words], words, text[low:high])
            if part >= NOTICE_COVERAGE:
                best[label] = max(part, best.get(label, 0))
                found.setdefault(label, []).append((s, s + len(words) - anchor))
    for longer, shorter in HOLDS.items():
        ranges = found.get(longer, [])
        if ranges and all(any(s < f and b < t for b, f in ranges) for s, t in found.get(shorter, [])):
            best.pop(shorter, None)
    return best


def changed(rng, words, part):
    """Words left out, put in and changed, ``part`` of all."""
    out = []
    for word in words:
        kind = rng.random() / part if part else 9
        if kind < 1 / 3:
            continue
        out.append("other" if kind < 2 / 3 else word)
        if 2 / 3 <= kind < 1:
            out.append("more")
    return out


def texts(rng):
    own = [n.split() for _, _, n in NOTICES]
    filler = sorted({w for n in own for w in n})
    for words in own:
        yield words
        yield ["x"] * rng.randint(0, 40) + changed(rng, words, 0.1) + ["y"] * rng.randint(0, 40)
        yield changed(rng, words, 0.3)
        yield words[: len(words) // 2]
    for _ in range(8):
        yield [w for n in rng.sample(own, 4) for w in n + rng.choices(filler, k=rng.randint(0, 60))]
    yield own[2] + own[1]
    yield own[1] + own[2]
    yield rng.choices(filler, k=3000)
    yield []


@pytest.mark.parametrize("seed", [1, 2])
def test_notices_match_plain_alignment(seed):
    rng = random.Random(seed)
    vocabulary = sorted({w for _, _, n in NOTICES for w in n.split()})
    counts = {w: rng.randint(0, 900) for w in vocabulary}
    idf = {w: math.log(1001 / (1 + counts[w])) for w in vocabulary}
    index = NoticeIndex({signed(word_hashes([w])).tolist()[0]: n for w, n in counts.items()}, 1000)
    some = 0
    for words in texts(rng):
        hashes = word_hashes(words) if words else word_hashes(["a"])[:0]
        got, wanted = index.scan(hashes, *index.words.find(hashes)), slow(words, lambda w: idf.get(w, 0.0))
        assert got == pytest.approx(wanted)
        some += len(got)
    assert some > 2 * len(NOTICES)


def test_notices_in_documents(spark):
    whole = {label: n for label, keys, n in NOTICES if len(keys) > 1}
    docs = [
        (1, whole["isc"], {"isc"}),
        (2, "Licensed under Apache 2.0.", {"apache-2.0"}),
        (3, "// SPDX-License-Identifier: BSD-3-Clause\nint main() {}", {"spdx-bsd-3-clause"}),
        (4, whole["bsd-3-clause"].upper(), {"bsd-3-clause", "bsd"}),
        (5, whole["bsd-2-clause"], {"bsd-2-clause", "bsd"}),
        (6, "word " * 70_000 + whole["zlib"], {"zlib"}),
        (7, whole["mit-text"].replace(" ", " * "), {"mit-text", "mit-grant"}),
        (8, " ".join(whole["mit-text"].split()[:60]), {"mit-grant"}),
        (9, "the software is provided as is, without a notice; permission is free of charge", set()),
        (10, whole["bsd-3-clause"] + "\n" + whole["bsd-2-clause"], {"bsd-3-clause", "bsd-2-clause", "bsd"}),
        (11, (whole["isc"] + "\n") * 300, {"isc"}),
        (12, None, set()),
        (13, "", set()),
    ]
    got = {r.doc_id: r for r in license_scan(fixtures.plain(spark, [d[:2] for d in docs])).collect()}
    assert {i: set(filter(None, r.labels.split(","))) for i, r in got.items()} == {i: want for i, _, want in docs}
    assert all(r.base_labels == "" and (r.score > 0) == (r.labels != "") for r in got.values())


def test_key_phrases_are_in_their_notices():
    for label, keys, text in NOTICES:
        assert tokens(text) == text.split()
        assert all(f" {k} " in f" {text} " for k in keys), label
    assert set(HOLDS) | set(HOLDS.values()) <= {n[0] for n in NOTICES}
    assert licenses.NOTICE_COVERAGE > 0.5
