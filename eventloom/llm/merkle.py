"""Merkle manifest of a table: leaves, subroots, root, and a proof for every row.

Leaves stand in blocks, the tree of a block is built in one task, and blocks find what is
above them by a butterfly exchange: in each round the blocks under the same parent send each
other the node they have reached, and every one hashes the parent for itself. So each block
holds its whole upper proof when the last round ends, and nothing is sent down again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import materialize

FANOUT = 3
#: Levels of the tree inside a block, so a block has at most 3^7 = 2187 leaves.
BLOCK_LEVELS = 7

#: A step of a proof: the siblings from left to right and how many of them stand before the node.
PROOF = "array<struct<place: int, siblings: array<string>>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_hash(columns: Sequence[Column]) -> Column:
    """Hash of values, each with its length, null told apart from any text."""

    def part(column: Column) -> Column:
        text = column.cast("string")
        sized = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        return F.coalesce(sized, F.lit("-"))

    return digest(*map(part, columns))


def _parents(level: list[str]) -> list[str]:
    runs = range(0, len(level), FANOUT)
    return [sha256("".join(level[i : i + FANOUT]).encode()).hexdigest() for i in runs]


def block_levels(leaves: list[str], alone: bool, levels: int) -> list[list[str]]:
    """Nodes of a block level by level: up to one node if it is alone, else ``levels`` times."""
    out = [leaves]
    while len(out[-1]) > 1 if alone else len(out) <= levels:
        out.append(_parents(out[-1]))
    return out


def _number(columns: int):
    """Streams rows sorted by group: first place of each row among those of its group in the task."""

    def run(batches):
        part, group, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = np.empty(batch.num_rows, dtype=np.int64)
            groups, copies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (own, count) in enumerate(zip(groups, copies)):
                if own != group:
                    group, at = own, 0
                places[i] = at
                at += count
            parts = pa.array(np.full(batch.num_rows, part, dtype=np.int32))
            arrays = [batch.column(i) for i in range(columns)] + [parts, pa.array(places)]
            yield pa.record_batch(arrays, [*batch.schema.names[:columns], "part", "place"])

    return run


def _blocks_of(batches):
    """Streams rows sorted by grp, block and place: the rows of one block after the other."""
    rows, here = [], None
    for batch in batches:
        for row in batch.to_pylist():
            key = row["grp"], row["block"]
            if key != here:
                if rows:
                    yield rows
                rows, here = [], key
            rows.append(row)
    if rows:
        yield rows


def _node(levels: int):
    """The node of each block."""

    def run(batches):
        for rows in _blocks_of(batches):
            first = rows[0]
            leaves = [r["leaf"] for r in rows for _ in range(r["copies"])]
            node = block_levels(leaves, first["total"] <= FANOUT**levels, levels)[-1][0]
            columns = {k: [first[k]] for k in ("grp", "block", "total")}
            yield pa.RecordBatch.from_pydict(columns | {"node": [node]})

    return run


def _placed(items: DataFrame, levels: int) -> DataFrame:
    """(grp, block, at, copies, leaf, payload, total): where the leaves of each group stand.

    ``items`` has grp, copies (equal rows counted), leaf and payload, a struct whose order is
    that of the leaves; total is the number of leaves of the group. Rows are numbered inside
    the tasks of a range partitioning, so a group that holds most rows is numbered by many
    tasks; only the sizes of their parts are added up.
    """
    width = FANOUT**levels
    order = ["grp", "payload", "leaf"]
    rows = items.select("grp", "copies", "leaf", "payload")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    numbered = ranged.mapInArrow(_number(len(rows.columns)), f"{schema}, part int, place long")
    numbered = materialize(numbered, "numbered")
    sizes = numbered.groupBy("grp", "part").agg(F.sum("copies").alias("size"))
    sizes = sizes.selectExpr(
        "grp", "part",
        "coalesce(sum(size) OVER (PARTITION BY grp ORDER BY part "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS before",
        "sum(size) OVER (PARTITION BY grp) AS total",
    )
    placed = numbered.join(sizes, ["grp", "part"]).withColumn("first", F.expr("before + place"))
    # copies of a row may lie in several blocks
    return placed.selectExpr(
        "grp", "payload", "leaf", "total", "first", "first + copies AS last",
        f"explode(sequence(first DIV {width}L, (first + copies - 1) DIV {width}L)) AS block",
    ).selectExpr(
        "grp", "block", f"greatest(first, block * {width}L) AS at",
        f"CAST(least(last, (block + 1) * {width}L) - greatest(first, block * {width}L) AS INT) AS copies",
        "leaf", "payload", "total",
    )


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "at")


def _nodes(placed: DataFrame, levels: int) -> DataFrame:
    """(grp, block, total, node) of every block."""
    rows = _in_order(placed.select("grp", "block", "at", "copies", "leaf", "total"))
    return materialize(
        rows.mapInArrow(_node(levels), "grp string, block long, total long, node string"), "nodes"
    )


def _exchange(state: DataFrame, width: int) -> DataFrame:
    """One round: blocks under the same parent swap nodes, each of ``width`` blocks wide.

    Block i gets its sibling nodes from the blocks with its own place inside them. A last node
    that is not full has fewer blocks; there they serve several receivers in turn.
    """
    sent = state.selectExpr(
        "*", f"block DIV {width}L AS own", f"block % {width}L AS low",
        f"least({width}L, n - block DIV {width}L * {width}L) AS size",
    ).selectExpr(
        "*",
        f"""explode(flatten(transform(
              filter(transform(sequence(0L, {FANOUT - 1}L), k -> own DIV {FANOUT} * {FANOUT} + k),
                     s -> s * {width}L + low < n),
              s -> IF(s = own, array(block),
                      sequence(s * {width}L + low, least((s + 1) * {width}L, n) - 1, size))))) AS to""",
    )
    met = sent.groupBy("grp", F.col("to").alias("block")).agg(
        F.sort_array(F.collect_list(F.expr(f"struct(own % {FANOUT} AS place, node)"))).alias("nodes"),
        F.max("n").alias("n"),
        F.first(F.expr("IF(to = block, proof, NULL)"), ignorenulls=True).alias("proof"),
    )
    step = f"""array(named_struct(
        'place', CAST(block DIV {width}L % {FANOUT} AS INT),
        'siblings', transform(filter(nodes, x -> x.place <> block DIV {width}L % {FANOUT}),
                              x -> x.node)))"""
    return met.selectExpr(
        "grp", "block", "n", "sha2(CAST(array_join(nodes.node, '') AS BINARY), 256) AS node",
        f"concat(proof, {step}) AS proof",
    )


def _upper(blocks: DataFrame, levels: int) -> DataFrame:
    """(grp, block, node, proof): root of the group and the steps from the block up to it."""
    width = FANOUT**levels
    state = blocks.selectExpr(
        "grp", "block", f"(total + {width - 1}) DIV {width} AS n", "node",
        f"CAST(array() AS {PROOF}) AS proof",
    )
    done, most = state.where("n = 1"), state.agg(F.max("n")).first()[0] or 0
    state, reach = state.where("n > 1"), 1
    while reach < most:
        # a group that has come to its root is done; the others go on
        state = materialize(_exchange(state, reach), "round")
        reach *= FANOUT
        done = done.unionByName(state.where(F.col("n") <= reach))
        state = state.where(F.col("n") > reach)
    return done.select("grp", "block", "node", "proof")


def _paths(leaves: list[str], below: list[list[str]], above: list[tuple[int, list[str]]]) -> pa.Array:
    """The proof of each leaf of a block."""
    places, sizes, siblings = [], [], []
    for i in range(len(leaves)):
        at = i
        for level in below:
            first = at - at % FANOUT
            others = level[first:at] + level[at + 1 : first + FANOUT]
            places.append(at - first)
            sizes.append(len(others))
            siblings += others
            at //= FANOUT
        for place, others in above:
            places.append(place)
            sizes.append(len(others))
            siblings += others
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(siblings, pa.string()))
    steps = pa.StructArray.from_arrays([pa.array(places, pa.int32()), lists], ["place", "siblings"])
    ends = np.arange(len(leaves) + 1) * (len(below) + len(above))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)


def _prove(levels: int):
    """Blocks, each led by what is above it, as rows of leaves with the whole proof of each."""

    def run(batches):
        kind, batches = None, iter(batches)

        def typed():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("payload").type
                yield batch

        for head, *rows in _blocks_of(typed()):
            leaves = [r["leaf"] for r in rows for _ in range(r["copies"])]
            payload = [r["payload"] for r in rows for _ in range(r["copies"])]
            below = block_levels(leaves, head["total"] <= FANOUT**levels, levels)[:-1]
            above = [(s["place"], s["siblings"]) for s in head["above"]]
            columns = [
                pa.array(payload, kind),
                pa.array(leaves, pa.string()),
                pa.array([head["subroot"]] * len(leaves), pa.string()),
                pa.array([head["root"]] * len(leaves), pa.string()),
                _paths(leaves, below, above),
            ]
            yield pa.record_batch(columns, ["payload", "leaf", "subroot", "root", "proof"])

    return run


def _proofs(placed: DataFrame, heads: DataFrame, levels: int) -> DataFrame:
    """(payload, leaf, subroot, root, proof) of every leaf.

    ``heads`` has grp, block, total, subroot, root and above, the steps from the block's node on.
    """
    kind = placed.schema["payload"].dataType.simpleString()
    heads = heads.selectExpr(
        "grp", "block", "-1L AS at", "0 AS copies", "CAST(NULL AS STRING) AS leaf",
        f"CAST(NULL AS {kind}) AS payload", "total", "subroot", "root", "above",
    )
    rows = _in_order(heads.unionByName(placed, allowMissingColumns=True))
    return rows.mapInArrow(
        _prove(levels), f"payload {kind}, leaf string, subroot string, root string, proof {PROOF}"
    )


def merkle_proofs(
    rows: DataFrame, group: Column, order: Column, leaf: Column, extra: Column | None = None,
    levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """(id, extra, leaf, subroot, root, proof) of every row.

    Leaves of a group ascend by ``order``, null first, ties by ``extra`` and hash; every three
    consecutive nodes, the last run fewer, become their hash until one is left, the subroot.
    Subroots in the order of their groups (UTF-8 bytewise, null first) make the root the same
    way. ``proof`` has a step for each level from the leaf to the root. id is the value of
    ``order``; ``extra`` is text that goes along.

    Equal rows are counted first and come back as often as they came in; no rows give none.
    A task holds a block of 3^levels leaves at most, whatever the size of a group, and what
    is sent in a round is three nodes and a proof for each block.
    """
    along = F.lit(None) if extra is None else extra
    payload = F.struct(order.alias("id"), along.cast("string").alias("extra"))
    # null comes before any text, the empty one included
    grp = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    items = rows.select(grp.alias("grp"), leaf.alias("leaf"), payload.alias("payload"))
    items = items.groupBy("grp", "leaf", "payload").agg(F.count("*").alias("copies"))
    placed = _placed(items, levels)
    nodes = _nodes(placed, levels)
    upper = _upper(nodes, levels)

    subroots = upper.where("block = 0").selectExpr(
        "'' AS grp", "1L AS copies", "node AS leaf", "named_struct('id', grp) AS payload"
    )
    top = _placed(subroots, levels)
    top_nodes = _nodes(top, levels)
    heads = _upper(top_nodes, levels).join(top_nodes.select("block", "total"), "block").selectExpr(
        "grp", "block", "total", "'' AS subroot", "node AS root", "proof AS above"
    )
    tops = _proofs(top, heads, levels).selectExpr("payload.id AS grp", "root", "proof AS top")
    tops = materialize(tops, "tops")

    heads = upper.join(tops, "grp").join(nodes.select("grp", "block", "total"), ["grp", "block"])
    heads = heads.selectExpr(
        "grp", "block", "total", "node AS subroot", "root", "concat(proof, top) AS above"
    )
    return _proofs(placed, heads, levels).select("payload.*", "leaf", "subroot", "root", "proof")


def proof_hash(proof: str) -> Column:
    """Hash of all siblings of a proof, from the leaf up, left to right."""
    return F.expr(
        f"sha2(CAST(array_join(flatten(transform({proof}, s -> s.siblings)), '') AS BINARY), 256)"
    )


def folded(proof: str, leaf: Column) -> Column:
    """The root that a leaf and its proof lead to."""

    def step(node: Column, s: Column) -> Column:
        before = F.array_join(F.slice(s.siblings, F.lit(1), s.place), "")
        after = F.array_join(F.slice(s.siblings, s.place + 1, F.lit(FANOUT)), "")
        return digest(before, node, after)

    return F.aggregate(proof, leaf, step)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def manifest(
    docs: DataFrame, now: Mapping[str, Column] | None = None, levels: int = BLOCK_LEVELS
) -> DataFrame:
    """(doc_id, now, leaf, subroot, root, proof) of every document, by source and doc_id.

    A leaf is the hash of doc_id, source, lang, n_chars and text. With ``now``, other values
    for some of these, the column now is the leaf of the document as it is at present; else it
    is null. Any value may be null. Other columns are ignored. See ``merkle_proofs``.
    """
    was = {c: F.col(f"`{c}`") for c in FIELDS}
    present = None if now is None else leaf_hash([(was | now)[c] for c in FIELDS])
    leaf = leaf_hash(list(was.values()))
    found = merkle_proofs(docs, was["source"], was["doc_id"].cast("long"), leaf, present, levels)
    return found.withColumnsRenamed({"id": "doc_id", "extra": "now"})
