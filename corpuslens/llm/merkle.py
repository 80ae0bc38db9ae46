"""Merkle manifest of a dataset: digests of rows, of groups and of the whole, with proofs that can be checked.

Every row is a leaf. Per group the leaves, in order, are hashed in runs of
ARITY, level by level, to a subroot; the subroots likewise to the root. Leaves
travel in superblocks of ARITY ** HEIGHT neighbours. A first pass reduces every
superblock to its top, the tops to theirs, and so on. The way down cogroups the
nodes of a superblock with the outer nodes that its proofs need: reduction,
proof and folding are finished there, in one exchange. No group of rows is
ever larger than a superblock, however large its source.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corpuslens.sources.store import write_table

ARITY = 3
HEIGHT = 7

PATH = "before array<string>, after array<string>"


def row_digest(*fields: Column) -> Column:
    """sha256 of the fields, each as its UTF-8 byte count, a colon and its value, or ``-`` for null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in texts]).cast("binary"), 256)


def node_digest(inputs: str) -> str:
    return sha256(inputs.encode()).hexdigest()


def climb(digests: list[str], levels: int | None = None) -> list[list[str]]:
    """The levels above ``digests``, themselves included: ``levels`` more, or up to a single node."""
    out = [digests]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        below = out[-1]
        out.append([node_digest("".join(below[i:i + ARITY])) for i in range(0, len(below), ARITY)])
    return out


def paths(levels: list[list[str]]) -> Iterator[tuple[list[str], list[str]]]:
    """Per bottom node, level by level: its run's siblings to its left and to its right, concatenated."""
    sides = []
    for level in levels[:-1]:
        side = []
        for j in range(len(level)):
            run = j - j % ARITY
            side.append(("".join(level[run:j]), "".join(level[j + 1:run + ARITY])))
        sides.append(side)
    for i in range(len(levels[0])):
        before, after = [], []
        for side in sides:
            left, right = side[i]
            before.append(left)
            after.append(right)
            i //= ARITY
        yield before, after


def fold(digest: str, before, after) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in zip(before, after):
        digest = node_digest(left + digest + right)
    return digest


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with n, the rows of their tree, and pos, their place in it (from 0) by ``order``, a total order.

    Rows are sorted by range, so that a tree may take many partitions; places come from the rows that a tree has in
    the partitions before.
    """
    keys = [F.asc_nulls_first(c) for c in ["tree", *order]]
    ordered = write_table(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                          .withColumn("_at", F.monotonically_increasing_id()), "merkle-ordered")
    ordered = ordered.withColumn("_part", F.shiftright("_at", 33))
    tree = W.partitionBy("tree")
    earlier = tree.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = (ordered.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
              .select("tree", "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
                      F.sum("_n").over(tree).alias("n")))
    return (ordered.join(starts, ["tree", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift"))
            .drop("_at", "_part", "_shift"))


def _packed(nodes: DataFrame, rows: int, block: int, column: str = "pos") -> DataFrame:
    """Superblocks by hash in packs of about one full superblock: small ones do not each become a group."""
    return nodes.withColumn("pack", F.pmod(F.xxhash64("tree", F.floor(F.col(column) / block)),
                                           F.lit(max(1, rows // block))))


def _superblocks(nodes: pd.DataFrame, block: int) -> Iterator[tuple[str, int, pd.DataFrame, list[list[str]]]]:
    """(tree, place, nodes, levels) of every superblock among ``nodes``."""
    nodes = nodes.assign(sb=nodes["pos"] // block).sort_values(["tree", "pos"])
    levels_of_block = 0
    while ARITY ** levels_of_block < block:
        levels_of_block += 1
    for (tree, sb), own in nodes.groupby(["tree", "sb"], sort=False):
        several = own["n"].iloc[0] > block
        yield tree, int(sb), own, climb(own["digest"].tolist(), levels_of_block if several else None)


class Forest:
    """Trees over nodes (tree, n, pos, digest), reduced stage by stage; each stage is a written table."""

    def __init__(self, nodes: DataFrame, height: int = HEIGHT):
        self.block = ARITY ** height
        self.stages: list[tuple[DataFrame, int, DataFrame]] = []     # nodes, their count, tops
        while True:
            rows = nodes.count()
            tops = write_table(self._tops(nodes, rows), "merkle-tops")
            self.stages.append((nodes, rows, tops))
            nodes = tops.filter("n > 1")
            if nodes.isEmpty():
                break
        found = self.stages[0][2]
        for _, _, tops in self.stages[1:]:
            found = found.union(tops)
        self.subroots = found.filter("n = 1").select("tree", F.col("digest").alias("subroot"))

    def _tops(self, nodes: DataFrame, rows: int) -> DataFrame:
        block = self.block

        def reduce(own: pd.DataFrame) -> pd.DataFrame:
            out = [(tree, -(-int(b["n"].iloc[0]) // block), sb, levels[-1][0])
                   for tree, sb, b, levels in _superblocks(own, block)]
            return pd.DataFrame(out, columns=["tree", "n", "pos", "digest"])

        packed = _packed(nodes.select("tree", "n", "pos", "digest"), rows, block)
        return packed.groupBy("pack").applyInPandas(reduce, "tree string, n long, pos long, digest string")

    def meet(self, bases: DataFrame, finish, schema: str, columns: list[str]) -> DataFrame:
        """``finish(node, before, after, base)`` of every bottom node, a tuple by ``schema``.

        ``bases``: tree, subroot, root and the path from the subroot on. ``columns`` are those of the nodes that
        ``finish`` reads.
        """
        outer = None
        for at in range(len(self.stages) - 1, -1, -1):
            nodes, rows, tops = self.stages[at]
            done = tops.filter("n = 1").select("tree").join(bases, "tree").withColumn("sb", F.lit(0).cast("long"))
            here = done.select("tree", "sb", "subroot", "root", "before", "after")
            outer = here if outer is None else here.unionByName(outer)
            if at:
                outer = write_table(self._joined(
                    nodes, rows, outer, lambda node, before, after, base: (
                        node["tree"], int(node["pos"]), base["subroot"], base["root"], before, after),
                    f"tree string, sb long, subroot string, root string, {PATH}", []), "merkle-outer")
        return self._joined(nodes, rows, outer, finish, schema, columns)

    def _joined(self, nodes: DataFrame, rows: int, outer: DataFrame, finish, schema: str,
                columns: list[str]) -> DataFrame:
        block = self.block
        names = [f.split()[0] for f in schema.split(", ")]

        def finished(own: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
            base_of = {(b["tree"], int(b["sb"])): b for b in outside.to_dict("records")}
            out = []
            for tree, sb, block_nodes, levels in _superblocks(own, block):
                base = base_of[tree, sb]
                above, beyond = list(base["before"]), list(base["after"])
                for node, (before, after) in zip(block_nodes.to_dict("records"), paths(levels)):
                    out.append(finish(node, before + above, after + beyond, base))
            return pd.DataFrame(out, columns=names)

        left = _packed(nodes.select("tree", "n", "pos", "digest", *columns), rows, block)
        right = _packed(outer.withColumn("_pos", F.col("sb") * block), rows, block, "_pos").drop("_pos")
        return left.groupBy("pack").cogroup(right.groupBy("pack")).applyInPandas(finished, schema)


def manifest(docs: DataFrame, fields: list[str], found: dict[str, Column] | None = None, id_col: str = "doc_id",
             group_col: str = "source", height: int = HEIGHT) -> DataFrame:
    """Per row: its id, leaf, subroot, root, before and after (the proof: siblings to the left and right, level by
    level), proof_sha256, folded_root and verified.

    A leaf is ``row_digest`` of ``fields``. Per group leaves ascend by id (null first; rows that repeat an id by their
    digests), groups by name, null first and apart from an empty name. A run's last members may be fewer, even one; a
    lone node is its own subroot. ``found`` gives fields as they are found now: the folded root is made of the digest
    of these and the siblings of the manifest, and a row is verified when it equals the root. An empty table gives no
    rows. Further columns of ``docs`` are not read. ``height`` levels make a superblock.
    """
    kind = docs.schema[id_col].dataType
    group = F.col(group_col).cast("string")
    leaf = row_digest(*[F.col(f) for f in fields])
    now = row_digest(*[(found or {}).get(f, F.col(f)) for f in fields])
    # a group's name as a key that is never null and keeps the order
    rows = docs.select(F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group)).alias("tree"),
                       F.col(id_col).alias("id"), leaf.alias("digest"), now.alias("now"))
    rows = rows.withColumn("now", F.when(F.col("now") != F.col("digest"), F.col("now")))
    rows = write_table(rows.withColumn("_row", F.monotonically_increasing_id()), "merkle-leaves")
    leaves = placed(rows, ["id", "digest", "_row"]).select(
        "tree", "n", "pos", F.col("id").cast("string").alias("id"), "digest", "now")
    groups = Forest(write_table(leaves, "merkle-placed"), height)
    subroots = groups.subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"),
                                      F.col("subroot").alias("digest"))
    whole = Forest(write_table(placed(subroots, ["name"]), "merkle-subroots"), height)
    top = whole.subroots.first()
    nothing = F.array().cast("array<string>")
    start = whole.subroots.select("tree", "subroot", F.col("subroot").alias("root"), nothing.alias("before"),
                                  nothing.alias("after"))
    bases = write_table(whole.meet(
        start, lambda node, before, after, base: (node["name"], node["digest"], base["root"], before, after),
        f"tree string, subroot string, root string, {PATH}", ["name"]), "merkle-bases")

    def checked(node: dict, before: list[str], after: list[str], base: dict) -> tuple:
        proof = node_digest("".join(x for pair in zip(before, after) for x in pair))
        digest = node["digest"] if node["now"] is None else node["now"]
        return (node["id"], node["digest"], base["subroot"], base["root"], before, after, proof,
                fold(digest, before, after))

    out = groups.meet(bases, checked, f"id string, leaf string, subroot string, root string, {PATH}, "
                      "proof_sha256 string, folded_root string", ["id", "now"])
    return out.select(F.col("id").cast(kind).alias(id_col), "leaf", "subroot", "root", "before", "after",
                      "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(top and top.subroot)).alias("verified"))
