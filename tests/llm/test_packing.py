import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from eventloom.llm import packing
from eventloom.llm.queries import END_ID, VOCABULARY, token_encoder
from tests.llm import fixtures


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


def plain_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [END_ID]


def test_encoder_equals_tokenizer(tokenizer):
    texts = [t or "" for t in fixtures.texts()]
    texts += ["It's DON'T ''s x'sy", "éa ́b É İstanbul ΣΑΣ ﬁ ²³ 12ab3 ½", " a b\x0bc\x1cd\u0085e", "a\xadb ŉ ǆ ß ẞ ſ K"]
    encode = token_encoder()()
    assert encode(texts) == [np.array(plain_ids(tokenizer, t), "<u4").tobytes() for t in texts]
    encode.known.most = 1  # forgets all the time
    for text in texts:
        assert encode([text]) == [np.array(plain_ids(tokenizer, text), "<u4").tobytes()]


@pytest.mark.parametrize("window,open_windows", [(64, 2), (4096, 32)])
def test_round_trip(spark, tokenizer, window, open_windows):
    docs = fixtures.frame(spark).repartition(5)
    got = packing.pack(docs, token_encoder(), window, open_windows).collect()
    sequences, texts = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
        texts[r.doc_id].append(r)
    short = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
        short += at < window
    assert short <= 1
    for r in fixtures.rows():
        if r[0] in (None, 10):
            continue
        ids, at = plain_ids(tokenizer, r[1]), 0
        for p in sorted(texts[r[0]], key=lambda p: p.start):
            part = np.array(ids[p.start : p.start + p.length], "<u4").tobytes()
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(part))
            at += p.length
        assert at == len(ids)
    total = sum(len(plain_ids(tokenizer, r[1])) for r in fixtures.rows())
    assert sum(r.length for r in got) == total


def test_leftovers_of_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "MERGED", 3)
    docs = fixtures.plain(spark, [(i, "word " * (i % 7)) for i in range(60)]).repartition(20)
    got = packing.pack(docs, token_encoder(), 16, 2).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r.sequence_id] += r.length
    assert sum(s < 16 for s in sizes.values()) <= 1


def test_empty(spark):
    assert packing.pack(fixtures.frame(spark, []), token_encoder()).collect() == []


def test_best_fit_takes_the_least_room():
    def piece(n):
        return packing.Piece(0, 0, b"\0\0\0\0" * n, n)

    windows = list(packing.best_fit(iter([piece(6), piece(5), piece(4)]), 10, 4))
    assert [[len(p) for p in w] for w in windows] == [[6, 4], [5]]


def test_time_is_linear_in_a_text():
    """A text of 16 million ids, whose copied rests would be 125 GB."""
    ids = np.arange(16 << 20, dtype="<u4").tobytes()
    began, at = time.process_time(), 0
    for window in packing.best_fit(iter([packing.Piece(1, 0, b"\0" * 400, 100), packing.Piece(2, 0, ids, 16 << 20)]), 4096, 1):
        for p in window:
            assert p.first == 0 and len(p.ids) <= 4 * 4096
            if p.doc_id == 2:
                assert p.start == at and p.ids == ids[4 * at : 4 * (at + len(p))]
                at += len(p)
    assert at == 16 << 20 and time.process_time() - began < 5
