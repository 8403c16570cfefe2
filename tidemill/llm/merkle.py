"""A Merkle manifest of a dataset: leaves, a tree of every group, a tree over the groups, proofs and their folding.

A row's leaf is the digest of its fields. Leaves of a group in order, and then the groups' roots in order, are
reduced by digests of every ARITY consecutive nodes until one is left.

Nodes get their places by ranges of (group, order, place in the input) and the ranges' counts, so no group is gathered. WIDTH, a
power of ARITY, consecutive nodes are a superblock; going up, each superblock becomes one node of the level above, until each
group has one. Going down, the nodes of a superblock and its row of outer nodes (the siblings above it, level by
level) are cogrouped: one function reduces the superblock once more, joins each node's own siblings to the
outer ones, and at the leaves digests the proof and folds the leaf as found now up to the root. Groups hold WIDTH
rows at most; outer nodes grow with the logarithm of the table.

A row has two leaves, as published and as found; the proof's siblings are the published ones. Where a proof is
folded from a row that was changed the result differs from the root.

Defined results: null fields count as ``-`` and empty ones as ``0:``; a null group is a group of its own and comes
first; a null id comes first in its group and is never tampered with; rows of one group and id are in the order of
their leaves, and equal rows are leaves of their own; a lone leaf is its group's root and a lone group's root the
root, with the digest of no siblings as proof; texts of any length count whole; an empty table gives an empty
result; further columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.session import cut_at, discard

ARITY = 3
#: Nodes of a superblock.
WIDTH = ARITY**6


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else its length in UTF-8 bytes, a colon and the value."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*[field(x) for x in fields]), 256)


# ---------------------------------------------------------------- one superblock


def heights(nodes: list[str], width: int, whole: bool) -> list[list[str]]:
    """A superblock's levels: to one node, or by as many levels as a full one has where others stand beside it."""
    levels = [nodes]
    depth = round(math.log(width, ARITY)) if whole else 0
    while len(levels[-1]) > 1 or len(levels) <= depth:
        now = levels[-1]
        levels.append([digest(*now[i : i + ARITY]) for i in range(0, len(now), ARITY)])
    return levels


def own_siblings(levels: list[list[str]], at: int) -> list[str]:
    """Per level the place of a node in its run and the others of the run: ``1abc...`` is place 1 beside abc..."""
    out = []
    for nodes in levels[:-1]:
        low = at - at % ARITY
        out.append(str(at - low) + "".join(nodes[low:at] + nodes[at + 1 : low + ARITY]))
        at //= ARITY
    return out


def folded(node: str, path: list[str]) -> str:
    for step in path:
        at = 1 + 64 * int(step[0])
        node = digest(step[1:at], node, step[at:])
    return node


# ---------------------------------------------------------------- places and levels


def placed(rows: DataFrame, group: str, order: list[str], scratch: list[str]) -> DataFrame:
    """Adds ``pos``, from 0 within a group, and ``total``, the group's rows.

    Ranges keep their order in the written table; one row per range and group is summed."""
    keys = [group, *order, "_place"]
    ranged = rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    dealt, path = cut_at(ranged.select(*rows.columns, F.spark_partition_id().alias("_part"), at.alias("_at")), "merkle-places")
    scratch.append(path)
    counts = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    w = Window.partitionBy(group)
    before = F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select(
        F.col(group).alias("_group"), F.col("_part").alias("_p"), (F.coalesce(before, F.lit(0)) - F.col("_from")).alias("_base"),
        F.sum("_n").over(w).alias("total"),
    )
    joined = dealt.join(bases, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.select(*rows.columns, (F.col("_base") + F.col("_at")).alias("pos"), "total")


def _blocks(nodes: DataFrame, width: int):
    return nodes.groupBy("grp", F.floor(F.col("pos") / width).cast("long").alias("block"))


def _in_order(block: pa.Table, width: int) -> tuple[pa.Table, list[list[str]]]:
    """A superblock's nodes by place, and its levels."""
    rows = block.take(pc.sort_indices(block["pos"]))
    return rows, heights(rows["node"].to_pylist(), width, rows["total"][0].as_py() > width)


def _up(width: int):
    def run(block: pa.Table) -> pa.Table:
        rows, levels = _in_order(block, width)
        pos, total = (rows[c][0].as_py() for c in ("pos", "total"))
        return pa.table({"grp": rows["grp"].slice(0, 1), "pos": [pos // width], "total": [-(-total // width)], "node": levels[-1]})

    return run


NODES = "grp {}, pos long, total long, node string"
OUTER = NODES + ", path array<string>, top string"


def _down(width: int):
    def run(nodes: pa.Table, outer: pa.Table) -> pa.Table:
        """The nodes of one superblock, with their siblings up to the group's node and that node."""
        rows, levels = _in_order(nodes, width)
        above = outer["path"][0].as_py()
        paths = pa.array([own_siblings(levels, i) + above for i in range(rows.num_rows)], pa.list_(pa.string()))
        return rows.append_column("path", paths).append_column("top", pa.array([outer["top"][0].as_py()] * rows.num_rows))

    return run


PROOF = "id {}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def _prove(width: int):
    def run(leaves: pa.Table, outer: pa.Table) -> pa.Table:
        """Leaves of one superblock and its outer nodes -> PROOF."""
        rows, levels = _in_order(leaves, width)
        above, subroot, root = (outer[c][0].as_py() for c in ("path", "top", "root"))
        proofs, ends = [], []
        for i, now in enumerate(rows["now"].to_pylist()):
            path = own_siblings(levels, i) + above
            proofs.append(digest(*(step[1:] for step in path)))
            ends.append(folded(now, path))
        n = rows.num_rows
        made = {"subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proofs, "folded_root": ends}
        return pa.table({"id": rows["id"], "leaf": rows["node"], **made})

    return run


def _levels(nodes: DataFrame, kind: str, width: int, scratch: list[str]) -> list[DataFrame]:
    """Superblocks' nodes above ``nodes`` until each group has one: a level for each power of ``width``."""
    out = []
    while True:
        up = _blocks(nodes, width).applyInArrow(_up(width), NODES.format(kind))
        nodes, path = cut_at(up, "merkle-level")
        scratch.append(path)
        out.append(nodes)
        if (nodes.agg(F.max("total")).first()[0] or 1) <= 1:
            return out


def _outer(levels: list[DataFrame], top: DataFrame, kind: str, width: int) -> DataFrame:
    """OUTER of the lowest level, from that of the one node that each group has at the top."""
    outer = top
    for nodes in reversed(levels[:-1]):
        above = outer.groupBy("grp", F.col("pos").alias("block"))
        outer = _blocks(nodes, width).cogroup(above).applyInArrow(_down(width), OUTER.format(kind))
    return outer


def manifest(rows: DataFrame, width: int = WIDTH, scratch: list[str] | None = None) -> DataFrame:
    """``rows`` (id, grp, node, now): leaves as published and as found -> PROOF of each.

    Superblocks hold ``width`` nodes, a power of ARITY. Folders that the result still reads are added to ``scratch``.
    """
    scratch = [] if scratch is None else scratch
    kind, id_kind = (rows.schema[c].dataType.simpleString() for c in ("grp", "id"))
    leaves, path = cut_at(placed(rows, "grp", ["id", "node"], scratch), "merkle-leaves")
    discard(rows.sparkSession, scratch.pop())
    scratch.append(path)
    levels = _levels(leaves.select("grp", "pos", "total", "node"), kind, width, scratch)
    # The groups' roots are the leaves of one more tree, whose group is always 0.
    subroots = levels[-1].select(F.lit(0).cast("long").alias("one"), F.col("grp").alias("name"), F.col("node"))
    tops, path = cut_at(placed(subroots, "one", ["name"], scratch).withColumnRenamed("one", "grp"), "merkle-subroots")
    discard(rows.sparkSession, scratch.pop())
    scratch.append(path)
    over = _levels(tops.select("grp", "pos", "total", "node"), "long", width, scratch)
    root = over[-1].select("*", F.array().cast("array<string>").alias("path"), F.col("node").alias("top"))
    shared = _outer([tops.select("grp", "pos", "total", "node"), *over], root, "long", width)
    named = tops.join(shared.select("pos", "path", F.col("top").alias("root")), "pos")
    group = named.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), F.lit(1).cast("long").alias("total"), "node", "path", F.col("node").alias("top"))
    below = _outer(levels, group, kind, width)
    of = named.select(F.col("name").alias("_name"), "root")
    outer = below.join(of, F.col("grp").eqNullSafe(F.col("_name"))).drop("_name")
    above = outer.groupBy("grp", F.col("pos").alias("block"))
    return _blocks(leaves, width).cogroup(above).applyInArrow(_prove(width), PROOF.format(id_kind))


def document_leaves(docs: DataFrame, id_col: str = "doc_id", group: str = "source", fields: tuple[str, ...] = ("source", "lang", "n_chars"), text: str = "text") -> DataFrame:
    """Rows for ``manifest``: a document's leaf, and its leaf after the tampering that takes line feeds out of the
    texts of ids with an even CRC-32."""
    head = [F.col(id_col), *[F.col(c) for c in fields]]
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    found = F.when(hit, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(F.col(text))
    return docs.select(
        F.col(id_col).alias("id"), F.col(group).alias("grp"), leaf(*head, F.col(text)).alias("node"), leaf(*head, found).alias("now")
    )
