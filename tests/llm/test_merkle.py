import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from eventloom.llm import merkle
from tests.llm import fixtures


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def slow_leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def slow_tree(leaves):
    """(root, proof of each leaf as (before, after) texts)."""
    level, at, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for proof, i in zip(proofs, at):
            first = i // 3 * 3
            proof.append(("".join(level[first:i]), "".join(level[i + 1 : first + 3])))
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
        at = [i // 3 for i in at]
    return level[0], proofs


def slow(rows, now=lambda row: row):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        own = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, slow_leaf(now(r)), slow_leaf(r)))
        trees[name] = own, *slow_tree([slow_leaf(r) for r in own])
    if not names:
        return []
    root, tops = slow_tree([trees[n][1] for n in names])
    out = []
    for name, top in zip(names, tops):
        own, subroot, proofs = trees[name]
        for row, proof in zip(own, proofs):
            proof = proof + top
            folded = slow_leaf(now(row))
            for before, after in proof:
                folded = h(before, folded, after)
            out.append((row[0], slow_leaf(row), subroot, root, h(*(b + a for b, a in proof)), folded))
    return sorted(out, key=repr)


def tampered(row):
    if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
        return (*row[:4], row[4].replace("\n", ""))
    return row


def ask(docs, levels):
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle.manifest(docs, {"text": text}, levels)
    found = found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_hash("proof"), merkle.folded("proof", F.col("now"))
    )
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_brute_force(spark, levels):
    rng = random.Random(levels)
    sizes = {"a": 61, "b": 1, "": 3, None: 10, "é": 4, "c": 28, "d": 9, "e": 163}
    rows = [
        (rng.randrange(10**6), source, "en", 3, f"t\n{i}" if i % 2 else None)
        for source, size in sizes.items()
        for i in range(size)
    ]
    rows += [(7, "a", None, None, "same\n")] * 40 + [(None, "d", "x", 1, "no id\n")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert ask(docs, levels) == slow(rows, tampered)


def test_edge_cases(spark):
    docs = fixtures.frame(spark)
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    assert ask(docs, 1) == slow(rows, tampered)
    assert ask(docs.limit(0), 1) == []
    one = [(5, "x", "en", 1, "a")]
    lone = spark.createDataFrame(one, "doc_id long, source string, lang string, n_chars long, text string")
    assert ask(lone, 1) == slow(one, tampered)


def test_every_change_is_found(spark):
    docs = spark.range(400).selectExpr(
        "id AS doc_id", "CAST(id % 7 AS STRING) AS source", "'en' AS lang", "id AS n_chars", "'t' AS text"
    )
    found = merkle.manifest(docs, {"n_chars": F.when(F.col("doc_id") == 123, 0).otherwise(F.col("n_chars"))}, 2)
    wrong = found.where(merkle.folded("proof", F.col("now")) != F.col("root"))
    assert [r.doc_id for r in wrong.collect()] == [123]
