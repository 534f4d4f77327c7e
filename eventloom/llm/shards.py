"""Searches of a stated set of query vectors in shards of all vectors."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import materialize, shuffle_partitions

#: (query vectors) -> for each the rows of the shard that may be among the k best, and scores
Answer = Callable[[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]


def matrix(column: pa.Array) -> np.ndarray:
    """Arrays of equal length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _runs(key: np.ndarray):
    """(start, end) of runs of equal values."""
    cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
    edges = np.concatenate([[0], cuts, [len(key)]]).tolist()
    return zip(edges[:-1], edges[1:])


def _stream(index: Callable[[np.ndarray], Answer], k: int, highest: bool, kind: pa.DataType):
    """Streams rows sorted by place: each shard's vectors, then the queries it answers."""

    def answered(answer, ids, batch):
        asked, scores, found = [], [], []
        for node, (rows, own) in zip(batch.column(3).to_pylist(), answer(matrix(batch.column(2)))):
            named = ((s, i) for r, s in zip(rows.tolist(), own.tolist()) for i in ids[r])
            best = sorted(named, key=lambda x: (-x[0] if highest else x[0], x[1]))[:k]
            asked += [node] * len(best)
            scores += [s for s, _ in best]
            found += [i for _, i in best]
        columns = [pa.array(asked, pa.int64()), pa.array(found, pa.int64()), pa.array(scores, kind)]
        return pa.record_batch(columns, ["asked", "vec_id", "score"])

    def run(batches):
        here, parts, ids, answer = None, [], [], None
        for batch in batches:
            place = batch.column(0).to_numpy(zero_copy_only=False)
            asks = batch.column(1).to_numpy(zero_copy_only=False)
            for start, end in _runs(place * 2 + asks) if len(place) else ():
                part = batch.slice(start, end - start)
                if place[start] != here:
                    here, parts, ids, answer = place[start], [], [], None
                if not asks[start]:
                    parts.append(matrix(part.column(2)))
                    ids += part.column(4).to_pylist()
                elif ids:
                    if answer is None:
                        answer, parts = index(np.concatenate(parts)), []
                    yield answered(answer, ids, part)

    return run


def _rank(partition: str, highest: bool) -> Column:
    score = F.desc("score") if highest else F.asc("score")
    return F.row_number().over(Window.partitionBy(partition).orderBy(score, "vec_id"))


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int,
    shard: int,
    index: Callable[[np.ndarray], Answer],
    score: str,
    highest: bool,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each query.

    ``vectors`` has vec_id and v; queries are the rows that ``is_query`` marks, candidates all
    rows with another vec_id. Equal vectors are one entry, with their k + 1 smallest ids, and
    equal queries are answered once, so a vector that a third of the rows share costs what any
    other does. Distinct vectors are dealt to shards of some ``shard`` by a hash; each travels
    once, and each query to every shard. A task holds one shard, its ``index`` and a batch of
    queries; work grows with queries times shards, as the stated query set demands.
    """
    rows = vectors.where("vec_id IS NOT NULL AND v IS NOT NULL").select(
        F.col("vec_id").cast("long").alias("vec_id"), "v", is_query.alias("asks")
    )
    smallest = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    nodes = rows.select("v", "vec_id").distinct().withColumn("n", smallest).where(f"n <= {k + 1}")
    nodes = nodes.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = materialize(nodes.withColumn("node", F.col("ids")[0]), "vectors")
    asks = rows.where("asks").select(F.col("vec_id").alias("query_id"), "v").distinct()
    asks = materialize(asks.join(nodes.select("v", "node"), "v"), "asks")

    shards = max(1, math.ceil(nodes.count() / shard))
    first = F.size("v").cast("long") * shards  # only vectors of equal length meet
    stored = nodes.select(
        (first + F.expr(f"pmod(xxhash64(node), {shards})")).alias("place"), F.lit(0).alias("asks"), "v", "node", "ids"
    )
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    wanted = asks.select("node", "v").distinct().select(first.alias("first"), "v", "node", every.alias("s"))
    wanted = wanted.select(
        (F.col("first") + F.col("s")).alias("place"),
        F.lit(1).alias("asks"), "v", "node", F.expr("CAST(NULL AS ARRAY<BIGINT>)").alias("ids"),
    )
    # no more tasks than shards; AQE must not merge them, as a shard is work, not bytes
    parts = max(1, min(shuffle_partitions(vectors), shards))
    met = stored.unionByName(wanted).repartition(parts, "place").sortWithinPartitions("place", "asks")
    kind = pa.float64() if score == "double" else pa.int64()
    found = met.mapInArrow(_stream(index, k + 1, highest, kind), f"asked long, vec_id long, score {score}")
    found = found.withColumn("rank", _rank("asked", highest)).where(f"rank <= {k + 1}").drop("rank")
    answers = asks.join(found, asks.node == found.asked).where("vec_id <> query_id")
    return answers.withColumn("rank", _rank("query_id", highest)).where(f"rank <= {k}").select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
