"""The registered queries of this package, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import documents
from eventloom.llm.decontaminate import contamination
from eventloom.llm.html_extract import extract_text
from eventloom.llm.licenses import license_scan
from eventloom.llm.merkle import folded, manifest, proof_hash
from eventloom.llm.neighbours import nearest, usable_vectors
from eventloom.llm.packing import WordEncoder, pack
from eventloom.llm.quality import quality_scores
from eventloom.llm.secrets import secret_scan
from eventloom.llm.sharding import shard_documents
from eventloom.llm.simhash import near_duplicates
from eventloom.llm.suffix_dedup import remove_repeats
from eventloom.llm.topk import exact_top_k, quantized
from eventloom.llm.whitening import integers, whiten
from eventloom.session import configure

#: The vocabulary and the id after each document, as the packed training data has them.
VOCABULARY, END_ID = "word_bpe_49k.json", 2

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(configure(spark), sf_dir)
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


@query()
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return near_duplicates(documents(spark, sf_dir)).drop("root", "text_key")


def token_encoder() -> Callable[[], WordEncoder]:
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    return lambda: WordEncoder(path, END_ID)


@query()
def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 4096 token ids."""
    return pack(documents(spark, sf_dir), token_encoder())


@query("""
WITH v AS (
  SELECT vec_id,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r
  FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
""")
def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every fiftieth embedding among all others."""
    vectors = quantized(documents(spark, sf_dir, "embeddings"))
    return exact_top_k(vectors, F.col("vec_id") % 50 == 0)


@query("""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), spans AS (
  SELECT item_id, w, least(13, len(w)) AS l,
         unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
  FROM b WHERE len(w) > 0
), passages AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS passage FROM spans
), lengths AS (SELECT DISTINCT l FROM passages
), places AS (
  SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, lengths WHERE len(w) >= l
), hits AS (
  SELECT doc_id, i, p.l, item_id
  FROM (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS passage FROM places) g
  JOIN passages p ON p.l = g.l AND p.passage = g.passage
), words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + l)) AS k FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(xs, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that benchmark passages cover."""
    found = contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return found.drop("text_key")


@query()
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    return license_scan(documents(spark, sf_dir))


@query()
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    found = secret_scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@query()
def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article text of every page."""
    return extract_text(documents(spark, sf_dir, "pages"))


@query()
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity of every document, and whether it is kept."""
    found = quality_scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
    return found.select("doc_id", "p_quality", "p_toxic", "score", "keep")


@query()
def op6_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sixteen shards of near equal bytes."""
    return shard_documents(documents(spark, sf_dir))


@query()
def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings of smaller ones."""
    return remove_repeats(documents(spark, sf_dir)).drop("kept")


@query()
def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found of every hundredth embedding among all others."""
    vectors = usable_vectors(documents(spark, sf_dir, "embeddings"))
    return nearest(vectors, F.col("vec_id") % 100 == 0)


@query("""
WITH RECURSIVE d AS (
  SELECT *, sha256(f || t) AS leaf,
         sha256(f || CASE WHEN text IS NULL THEN '-'
                          ELSE strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '') END) AS stripped
  FROM (
    SELECT doc_id, coalesce('=' || source, '') AS grp, text,
           coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
           || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-')
           || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS f,
           coalesce(strlen(text) || ':' || text, '-') AS t,
           list_reduce(list_concat([4294967295], list_transform(
             string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
             lambda crc, c: list_reduce(list_concat([xor(crc, c)], [0, 0, 0, 0, 0, 0, 0, 0]),
               lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)
           ) % 2 AS crc_odd
    FROM documents)
), leaves AS (
  -- without the last step of a CRC, which flips all bits, odd stands for even
  SELECT grp, doc_id, leaf, CASE WHEN crc_odd = 1 THEN stripped ELSE leaf END AS now,
         row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY grp) AS n
  FROM d
), nodes AS (
  SELECT grp, 0 AS lvl, pos, leaf AS h, n FROM leaves
  UNION ALL
  SELECT grp, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3
  FROM nodes WHERE n > 1 GROUP BY grp, lvl, pos // 3, n
), subroots AS (
  SELECT grp, lvl AS height, h, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n
  FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS lvl, pos, h, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3
  FROM tops WHERE n > 1 GROUP BY lvl, pos // 3, n
), tall AS (SELECT lvl AS height, h AS root FROM tops WHERE n = 1
), steps AS (
  SELECT x.grp, x.leaf_pos, x.lvl, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < x.pos), '') AS b,
         coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > x.pos), '') AS a
  FROM (SELECT l.grp, l.pos AS leaf_pos, k.lvl, l.pos // CAST(power(3, k.lvl) AS BIGINT) AS pos
        FROM leaves l JOIN subroots r USING (grp), (SELECT unnest(range(60)) AS lvl) k
        WHERE k.lvl < r.height) x
  LEFT JOIN nodes s ON s.grp = x.grp AND s.lvl = x.lvl AND s.pos // 3 = x.pos // 3 AND s.pos <> x.pos
  GROUP BY ALL
), upper AS (
  SELECT x.grp, x.lvl, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < x.pos), '') AS b,
         coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > x.pos), '') AS a
  FROM (SELECT r.grp, k.lvl, r.pos // CAST(power(3, k.lvl) AS BIGINT) AS pos
        FROM subroots r, (SELECT unnest(range(60)) AS lvl) k, tall WHERE k.lvl < tall.height) x
  LEFT JOIN tops s ON s.lvl = x.lvl AND s.pos // 3 = x.pos // 3 AND s.pos <> x.pos
  GROUP BY ALL
), paths AS (
  SELECT grp, leaf_pos, lvl, b, a FROM steps
  UNION ALL
  SELECT l.grp, l.pos, r.height + u.lvl, u.b, u.a
  FROM leaves l JOIN subroots r USING (grp) JOIN upper u USING (grp)
), proofs AS (
  SELECT grp, leaf_pos, list(b ORDER BY lvl) AS bs, list(a ORDER BY lvl) AS as_,
         sha256(string_agg(b || a, '' ORDER BY lvl)) AS proof_sha256
  FROM paths GROUP BY ALL
), folds AS (
  SELECT l.grp, l.pos, 1 AS i, now AS h, p.bs, p.as_
  FROM leaves l LEFT JOIN proofs p ON p.grp = l.grp AND p.leaf_pos = l.pos
  UNION ALL
  SELECT grp, pos, i + 1, sha256(bs[i] || h || as_[i]), bs, as_ FROM folds WHERE i <= len(bs)
)
SELECT l.doc_id, l.leaf, r.h AS subroot, t.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
       f.h AS folded_root, f.h = t.root AS verified
FROM leaves l JOIN subroots r USING (grp) CROSS JOIN tall t
LEFT JOIN proofs p ON p.grp = l.grp AND p.leaf_pos = l.pos
JOIN folds f ON f.grp = l.grp AND f.pos = l.pos AND f.i = coalesce(len(f.bs), 0) + 1
""")
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and roots of every document; half of them are checked without line breaks."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = manifest(documents(spark, sf_dir), {"text": text})
    found = found.withColumn("folded_root", folded("proof", F.col("now")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", proof_hash("proof").alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query()
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding in the terms of sixteen whitened components."""
    rows = documents(spark, sf_dir, "embeddings")
    return whiten(rows.select("vec_id", integers("embedding", 64, 1_000_000).alias("x")))
