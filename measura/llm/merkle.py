"""Merkle manifest of a table, with a version of the tree for each tampered leaf.

Leaves are rows, one tree for each value of ``by``; eight consecutive nodes become their parent while a level has several nodes, and the
trees' roots form the last tree in the same way. Trees are cut into aligned blocks of ``FAN ** DEPTH`` leaves, whose nodes one task holds
(4,096 leaves); the roots of blocks are the leaves of the next blocks. A group is a block, so neither a large tree nor the number of
trees puts more than that into one task. Positions in a tree come from a range partitioning by (tree, id) and the counts of its parts.

Versions are persistent: a tampered leaf copies only its ancestors within its block, and every other node is shared with the original.
The version goes on in the blocks above: their untouched nodes come to the block as its path, the siblings of each level, by a join.
Untampered leaves are folded in the same way.

Defined cases: null fields are ``-``. Rows without an id come first in their tree; rows with equal ids are ordered by their leaf. Rows
given twice are two leaves. A null ``by`` is a tree of its own, before the others. A row without an id is not tampered with. An empty
table gives no rows. Other columns, whatever their names, are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, materialize

FAN, DEPTH = 8, 4
BLOCK = FAN ** DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(value: str | None) -> bytes:
    if value is None:
        return b"-"
    value = value.encode()
    return b"%d:%b" % (len(value), value)


def lower_text(row: list[str | None], names: tuple[str, ...]) -> list[str | None]:
    """The text with A to Z in lower case; bytes.lower changes no others."""
    return [v if v is None or n != "text" else v.encode().lower().decode() for v, n in zip(row, names)]


def third_of_ids(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0, F.lit(False))


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", by: str = "lang", tampered: Column | None = None,
           change: Callable = lower_text) -> DataFrame:
    """(id, tree, leaf, altered): the leaf of each row, and its leaf after tampering where it is tampered with. ``tree`` sorts as ``by``
    does, null first, and is never null."""
    id_type = dict(docs.dtypes)[id_col]
    tree = F.coalesce(F.concat(F.lit("="), F.col(by)), F.lit(""))
    hit = third_of_ids(id_col) if tampered is None else tampered
    rows = docs.select(F.col(id_col).alias("id"), tree.alias("tree"), hit.alias("hit"), *(F.col(c).cast("string").alias(f"v{k}") for k, c in enumerate(fields)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf, altered = [], []
            for at in range(len(b)):  # one row's texts at a time
                hit, *row = (b.column(k)[at].as_py() for k in range(2, b.num_columns))
                leaf.append(hashlib.sha256(b"".join(map(encoded, row))).digest())
                altered.append(hashlib.sha256(b"".join(map(encoded, change(row, fields)))).digest() if hit else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf, pa.binary()), pa.array(altered, pa.binary())], ["id", "tree", "leaf", "altered"])

    return rows.mapInArrow(run, f"id {id_type}, tree string, leaf binary, altered binary")


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``pos``, the place in the tree by ``order``, and ``n``, the tree's number of nodes. Written."""
    ranges = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranked = materialize(ranges.withColumn("__m", F.monotonically_increasing_id()), "merkle-ranked")
    part = F.shiftright("__m", 33).alias("__p")
    counts = ranked.groupBy("tree", part).agg(F.min("__m").alias("__lo"), F.count(F.lit(1)).alias("__c"))
    before = F.sum("__c").over(Window.partitionBy("tree").orderBy("__p").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__c")
    starts = counts.select("tree", "__p", (before - F.col("__lo")).alias("__s"), F.sum("__c").over(Window.partitionBy("tree")).alias("n"))
    # A row for each range and one more for each tree.
    starts = checked_broadcast(materialize(starts, "merkle-starts"))
    out = ranked.withColumn("__p", F.shiftright("__m", 33)).join(starts, ["tree", "__p"])
    return materialize(out.select(*nodes.columns, (F.col("__m") + F.col("__s")).alias("pos"), "n"), "merkle-placed")


class Block:
    """The nodes of one aligned block, level by level. Versions share them."""

    def __init__(self, nodes: list[str], n: int):
        self.levels = [nodes]
        while n > 1 and len(self.levels) <= DEPTH:
            below = self.levels[-1]
            self.levels.append([digest(*below[k:k + FAN]) for k in range(0, len(below), FAN)])
            n = -(-n // FAN)

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def siblings(self, at: int) -> list[tuple[str, str]]:
        """What stands before and after the node in its run, for each level below the block's root."""
        out = []
        for nodes in self.levels[:-1]:
            first = at // FAN * FAN
            out.append(("".join(nodes[first:at]), "".join(nodes[at + 1:first + FAN])))
            at //= FAN
        return out

    def version(self, at: int, leaf: str) -> list[str]:
        """The copied ancestors of a changed leaf, from the leaf up to the block's new root; all other nodes stay this block's."""
        path = [leaf]
        for nodes in self.levels[:-1]:
            first = at // FAN * FAN
            path.append(digest(*nodes[first:at], path[-1], *nodes[at + 1:first + FAN]))
            at //= FAN
        return path


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("pos")


def roots_of_blocks(nodes: DataFrame) -> DataFrame:
    """(tree, pos, n, leaf): the roots of blocks as nodes of the next level. Written."""

    def run(table: pa.Table) -> pa.Table:
        t = _in_order(table)
        n, pos = t["n"][0].as_py(), t["pos"][0].as_py()
        root = Block([x.hex() for x in t["leaf"].to_pylist()], n).root
        return pa.table({"tree": [t["tree"][0].as_py()], "pos": [pos // BLOCK], "n": [-(-n // BLOCK)], "leaf": [bytes.fromhex(root)]},
                        schema=pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("leaf", pa.binary())]))

    got = nodes.select("tree", "pos", "n", "leaf").groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).applyInArrow(run, "tree string, pos long, n long, leaf binary")
    return materialize(got, "merkle-roots")


def levels_of(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` and the levels of block roots above, up to one where each tree has one node."""
    out = [nodes]
    while True:
        out.append(roots_of_blocks(out[-1]))
        if not out[-1].where("n > 1").head(1):
            return out


PATH = "array<struct<before: string, after: string>>"


def _grouped(nodes: DataFrame, above: DataFrame):
    """Blocks of ``nodes`` beside the rows of ``above`` for their roots."""
    return nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).cogroup(above.withColumnRenamed("pos", "block").groupBy("tree", "block"))


def paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, pos, path) of each node, from the paths of the block roots ``above``. Written; for levels above the leaves."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        t, up = _in_order(left), right["path"].to_pylist()[0]
        block = Block([x.hex() for x in t["leaf"].to_pylist()], t["n"][0].as_py())
        own = [[{"before": a, "after": z} for a, z in block.siblings(k)] + up for k in range(len(t))]
        pair = pa.struct([("before", pa.string()), ("after", pa.string())])
        return pa.table({"tree": t["tree"], "pos": t["pos"], "path": pa.array(own, pa.list_(pair))})

    return materialize(_grouped(nodes, above).applyInArrow(run, f"tree string, pos long, path {PATH}"), "merkle-paths")


def down(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """Paths of the roots of the leaves' blocks, from those of the trees' roots."""
    for nodes in levels[-2:0:-1]:
        top = paths(nodes, top)
    return top


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", by: str = "lang", tampered: Column | None = None,
             change: Callable = lower_text) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row. ``tampered`` tells which rows ``change`` alters, for
    the versions; by default every third by crc32 of the id, whose text is put into lower case."""
    id_type = dict(docs.dtypes)[id_col]
    rows = placed(materialize(leaves(docs, fields, id_col, by, tampered, change), "merkle-leaves"), ["id", "leaf"])
    trees = levels_of(rows)
    # The trees' roots in the order of their names are the leaves of the last tree.
    subroots = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "leaf")
    tops = placed(subroots, ["name"])
    last = levels_of(tops)
    start = last[-1].select("tree", "pos", F.array().cast(PATH).alias("path"))
    top = paths(tops, down(last, start)).join(tops.select("pos", "name", F.lower(F.hex("leaf")).alias("subroot")), "pos")
    top = materialize(top.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", "subroot"), "merkle-tops")
    above = down(trees, top.drop("subroot"))
    above = above.join(checked_broadcast(top.select("tree", "subroot")), "tree")
    above = above.join(F.broadcast(last[-1].select(F.lower(F.hex("leaf")).alias("root"))))  # one row

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        t, up = _in_order(left), right["path"].to_pylist()[0]
        subroot, root = right["subroot"][0].as_py(), right["root"][0].as_py()
        upper = "".join(x["before"] + x["after"] for x in up)
        block = Block([x.hex() for x in t["leaf"].to_pylist()], t["n"][0].as_py())
        proof, folded = [], []
        for k, altered in enumerate(t["altered"].to_pylist()):
            proof.append(digest(*(a + z for a, z in block.siblings(k)), upper))
            node = block.version(k, altered.hex() if altered is not None else block.levels[0][k])[-1]
            for x in up:  # the version goes on above
                node = digest(x["before"], node, x["after"])
            folded.append(node)
        n = len(t)
        return pa.table({"id": t["id"], "leaf": block.levels[0], "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proof, "folded_root": folded,
                         "verified": [x == root for x in folded]})

    got = _grouped(rows, above).applyInArrow(run, f"id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return got.withColumnRenamed("id", id_col)
