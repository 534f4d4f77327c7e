"""Balanced shards of documents by vector bin packing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import materialize

#: Groups of equal texts that are small go to one of so many bundles by hash.
BUNDLES = 4096
#: A group that must be cut becomes parts of one in so many of a shard's share.
CUT = 16
MEASURES = ["size", "tokens", "n"]


def place_items(needs: np.ndarray, shards: int) -> np.ndarray:
    """A shard for each item (bytes, tokens, rows; shares of the total).

    Largest first, each to the shard whose residual capacity has the greatest dot product
    with the item's needs, among those that still have room for its bytes; if none has, to
    the one with most room for bytes.
    """
    residual = np.full((shards, needs.shape[1]), 1 / shards)
    order = np.lexsort((np.arange(len(needs)), -needs[:, 0]))
    placed = np.zeros(len(needs), dtype=np.int64)
    for item in order.tolist():
        need = needs[item]
        fits = residual[:, 0] >= need[0]
        score = np.where(fits, residual @ need, -np.inf) if fits.any() else residual[:, 0]
        best = int(score.argmax())
        placed[item] = best
        residual[best] -= need
    return placed


def shard_documents(docs: DataFrame, shards: int = 16, bundles: int = BUNDLES) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of documents.

    Law ``bytes``: the shards' sizes (UTF-8 bytes of the text and one more per row) are near
    equal; tokens, counted as blank characters and one, and rows are balanced along with
    them. Groups are rows with equal text. A group of more than one part in ``bundles`` of
    all bytes, tokens or rows is an item of its own; there are at most three times
    ``bundles``. It stays in one shard unless it has more than a shard's share of bytes;
    then, and only then, it is cut by hashes of doc_ids. All other groups are whole members
    of a bundle by their hash, and the bundles are items as well. So the driver places a
    bounded number of items, whatever the number of documents. Slots count from 0 in each
    shard without a gap. grown_shard is null under this law.

    Null text has no bytes, so size 1 and checksum 0, and is a group with the empty one.
    Repeated rows and rows with a null doc_id have a slot each. Other columns are ignored;
    no documents give no rows.
    """
    text = F.coalesce("text", F.lit(""))
    blank = F.length(text) - F.length(F.translate(text, " \n\t\r", ""))
    facts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        (blank + 1).cast("long").alias("tokens"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.md5(text).alias("key"),
    )
    facts = materialize(facts, "facts")
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]
    groups = materialize(facts.groupBy("key").agg(*sums), "groups")
    whole = groups.agg(*[F.sum(m) for m in MEASURES]).first()
    if whole[0] is None:
        whole = (1, 1, 1)
    large = " OR ".join(f"{m} * {bundles} > {t}" for m, t in zip(MEASURES, whole))
    bundle = F.expr(f"CAST(pmod(xxhash64(key), {bundles}) AS INT)")

    heavy = groups.where(large).orderBy("key").collect()  # at most 3 * bundles rows
    light = groups.where(f"NOT ({large})").groupBy(bundle.alias("item"))
    light = {r["item"]: r for r in light.agg(*[F.sum(m).alias(m) for m in MEASURES]).collect()}
    items = [[light[i][m] if i in light else 0 for m in MEASURES] for i in range(bundles)]
    named = []  # key, first item, parts
    for r in heavy:
        over = r["size"] * shards > whole[0]
        parts = -(-r["size"] * shards * CUT // whole[0]) if over else 1
        named.append((r["key"], len(items), int(parts)))
        items += [[r[m] / parts for m in MEASURES]] * int(parts)
    spark = docs.sparkSession
    # bounded by 3 * bundles rows of some 50 bytes
    known = F.broadcast(spark.createDataFrame(named, "key string, first int, parts int"))
    item = F.expr("first + pmod(xxhash64(doc_id), parts)").cast("int")
    units = facts.join(known, "key", "left").withColumn("item", F.coalesce(item, bundle))
    for r in units.where("parts > 1").groupBy("item").agg(*sums).collect():
        items[r["item"]] = [r[m] for m in MEASURES]  # hashes cut only about evenly
    placed = place_items(np.array(items, dtype=float) / np.array(whole, dtype=float), shards)

    # a hot item is numbered in parts too
    units = units.withColumn("part", F.expr(f"pmod(xxhash64(doc_id, 7), {max(1, bundles // 64)})"))
    units = units.withColumn("part", F.when(F.col("first").isNull(), 0).otherwise(F.col("part")))
    counts = units.groupBy("item", "part").agg(F.count("*").alias("n")).collect()
    starts, filled = [], [0] * shards
    for r in sorted(counts):
        shard = int(placed[r["item"]])
        starts.append((r["item"], r["part"], shard, filled[shard]))
        filled[shard] += r["n"]
    # a row for each bundle and for each of 64 parts of the other items, some 24 bytes each
    starts = F.broadcast(spark.createDataFrame(starts, "item int, part long, shard int, start long"))
    order = Window.partitionBy("item", "part").orderBy("doc_id", "text_crc32")
    return (
        units.withColumn("rank", F.row_number().over(order))
        .join(starts, ["item", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("start") + F.col("rank") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
