"""The stages one after the other, each against what a plain reading of its input gives."""

from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from eventloom.llm.queries import ORACLE, QUERIES
from tests.llm import fixtures
from tests.llm.test_decontaminate import slow as slow_hits
from tests.llm.test_secrets import slow as slow_spans
from tests.llm.test_simhash import slow_fingerprint, slow_roots

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return out


def test_stages(spark, results):
    columns = results[0][1].columns
    rows = [{r.doc_id: r for r in df.collect()} if df.columns == columns else df.collect() for _, df in results]
    documents, good, single, clean, masked, packed = rows
    labels = duckdb.sql(f"SELECT doc_id FROM '{FOLDER}/labels.parquet' WHERE quality = 1 AND toxic = 0").fetchall()
    kept = sum(i in good for (i,) in labels)
    assert kept >= 0.95 * len(labels)
    assert all(documents[i] == r for i, r in good.items())

    marks = {i: slow_fingerprint(r.text) for i, r in good.items()}
    roots, least = slow_roots(marks.values()), {}
    for i, m in sorted(marks.items()):
        least.setdefault(roots[m], i)
    assert sorted(single) == sorted(least.values())

    items = duckdb.sql(f"SELECT item_id, text FROM '{FOLDER}/benchmark.parquet'").fetchall()
    hit = {i for i, r in single.items() if slow_hits(r.text, items)[-1]}
    assert sorted(clean) == sorted(set(single) - hit)

    assert sorted(masked) == sorted(clean)
    for i, r in masked.items():
        if not slow_spans(clean[i].text) and "[SECRET]" not in r.text:
            assert r == clean[i]
        assert not slow_spans(r.text) and r.n_chars == len(r.text)

    sizes = defaultdict(int)
    for r in packed:
        sizes[r.sequence_id] += r.length
    assert {r.doc_id for r in packed} == set(masked)
    assert sum(s < 4096 for s in sizes.values()) <= 1


def test_run(spark, results):
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in results[-1][1].collect()}


def test_stages_take_edge_cases(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for rows in (fixtures.rows(), []):
        docs = fixtures.frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars", "row")
        from eventloom.llm.quality import quality_scores

        assert quality_scores(docs, labels).where("keep").count() == len(rows)
        for name, stage in corpus_pipeline.STAGES[1:]:
            got = stage(spark, docs, FOLDER)
            if name != "packing":
                assert got.columns == docs.columns
            got.count()


def test_registration():
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert set(ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want = con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
