import random
import re

from eventloom.llm.common import signed
from eventloom.llm.licenses import PHRASES, TEMPLATES, LicenceIndex, license_scan, word_hashes
from tests.llm import fixtures


def tokens(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def slow(text):
    words, starts, labels = tokens(text), [], set()
    for phrase, label in PHRASES.items():
        own = phrase.split()
        for i in range(len(words) - len(own) + 1):
            if words[i : i + len(own)] == own:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_matches_brute_force(spark):
    rows = fixtures.rows()
    extra = [
        "MIT License mit license, gnu GENERAL public license; apache cc by cc-by-sa",
        "gnu general public", "license apache license", "é mit license", "mit\0license", "mit licenses",
        "the " * 5000 + "apache license",
    ]
    rows += [(1000 + i, t, *rows[0][2:]) for i, t in enumerate(extra)]
    got = license_scan(fixtures.frame(spark, rows)).collect()
    assert sorted(((r.doc_id, *tuple(r)[1:6]) for r in got), key=str) == sorted(((r[0], *slow(r[1])) for r in rows), key=str)
    for r in got:
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_templates(spark):
    changed = [
        (1, "Permission is hereby granted, free of charge, to any person obtaining a copy of this program", "mit-grant"),
        (2, "x " * 50 + TEMPLATES[10][2] + " y" * 50, "bsd"),
        (3, "permission is granted free of charge to any person", ""),
        (4, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
        (5, "mozilla public license", ""),
        (6, "Licensed under the Apache License, Version 2.0", "apache,apache-2.0"),
        (7, "under the terms of the GNU Lesser General Public License", "lgpl"),
    ]
    docs = fixtures.plain(spark, [(i, t) for i, t, _ in changed])
    assert {r.doc_id: r.labels for r in license_scan(docs).collect()} == {i: w for i, _, w in changed}


def test_empty(spark):
    assert license_scan(fixtures.frame(spark, [])).collect() == []


def test_all_templates_in_one_text(spark):
    """Also where word counts give the key phrases fourteen different marks."""
    rng, text = random.Random(981), " ".join(t for _, _, t in TEMPLATES)
    words = sorted({w for _, key, _ in TEMPLATES for w in key.split()})
    index = LicenceIndex({signed(word_hashes([w])).tolist()[0]: rng.randint(1, 99) for w in words}, 100)
    assert len(index.marks) == 14
    hashes = word_hashes(text.split())
    _, _, found, best = index.scan(hashes, index.rare_places(hashes))
    assert found == {label for label, _, _ in TEMPLATES} and best == 1.0
    (row,) = license_scan(fixtures.plain(spark, [(1, text)])).collect()
    assert found <= set(row.labels.split(","))
