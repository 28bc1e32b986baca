"""A Merkle manifest of a table: a tree for each group of rows, and one over the groups.

A block is an aligned run of consecutive nodes. It keeps each of its levels as one string of
concatenated hex digests: parents are digests of fixed-width substrings, and a node's siblings are
the substrings that flank it. Roots of blocks are the nodes of the next round.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.places import key_of, with_places
from factorloom.llm.text import fresh, let
from factorloom.session import settle

#: Hex characters of a digest.
HEX = 64
#: Leaves of a block at most.
BLOCK = 1024


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: Sequence[Column]) -> Column:
    """Hex digest of a row: its fields, concatenated."""
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings, level by level, lead to."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))


def _parents(level: Column, arity: int) -> Column:
    """The next level of a level, both as bytes of hex text (in bytes a substring is found without a scan)."""
    width = HEX * arity
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / width).cast("int"))
    return F.array_join(F.transform(runs, lambda r: F.sha2(F.substr(level, r * width + 1, F.lit(width)), 256)), "").cast("binary")


def _levels(nodes: Column, depth: int, arity: int, alone: Column) -> Column:
    """Array of the levels of a block, the nodes themselves first.

    A block that isn't alone in its group goes up ``depth`` levels, so its root stands where the
    group's whole tree has it; one that is alone ends at its single node.
    """
    first = F.array(F.array_join(nodes, "").cast("binary"))

    def step(levels, _):
        last = F.element_at(levels, -1)
        return F.when(alone & (F.length(last) == HEX), levels).otherwise(F.array_append(levels, let(last, lambda x: _parents(x, arity))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), first, step)


def _siblings(levels: Column, i: Column, arity: int, depth: int) -> Column:
    """What stands left and right of the block's node ``i`` and its ancestors in their runs, level by level."""
    span = F.array(*[F.lit(arity**k) for k in range(depth + 1)])

    def flanks(level, k):
        node = F.floor(i / F.get(span, k)).cast("int")
        run = node - F.pmod(node, F.lit(arity))
        left = F.substr(level, run * HEX + 1, (node - run) * HEX)
        right = F.substr(level, (node + 1) * HEX + 1, (run + arity - node - 1) * HEX)
        return F.struct(left.cast("string").alias("left"), right.cast("string").alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), flanks)


@dataclass
class Tree:
    """Blocks of each round, from the leaves up: (group_key, block, members, levels).

    ``members`` of the first round hold the row's kept columns, those of others only the node.
    """

    rounds: list[DataFrame]
    depth: int
    arity: int

    def roots(self) -> DataFrame:
        """(group_key, node): the root of every group."""
        return self.rounds[-1].select("group_key", F.element_at("levels", -1).cast("string").alias("node"))


def build_tree(nodes: DataFrame, arity: int = 2, block: int = BLOCK) -> Tree:
    """The trees over ``nodes``: group_key, place, total, node, and ``row``, a struct that goes with the node.

    Each round groups at most ``block`` nodes to a row and writes it; the next one has that many
    times fewer. Rounds end when the largest group has one block.
    """
    depth = 1
    while arity ** (depth + 1) <= block:
        depth += 1
    width, rounds = arity**depth, []
    most = nodes.agg(F.max("total")).first()[0] or 0
    while True:
        members = F.sort_array(F.collect_list(F.struct("place", "node", "row")))
        blocks = nodes.groupBy("group_key", F.floor(F.col("place") / width).alias("block")).agg(members.alias("members"), F.first("total").alias("total"))
        levels = _levels(F.col("members")["node"], depth, arity, F.col("total") <= width)
        rounds.append(settle(blocks.select("group_key", "block", "total", "members", levels.alias("levels")), "merkle"))
        if most <= width:
            return Tree(rounds, depth, arity)
        most = -(-most // width)
        nodes = rounds[-1].select(
            "group_key", F.col("block").alias("place"), F.ceil(F.col("total") / width).alias("total"),
            F.element_at("levels", -1).cast("string").alias("node"), F.struct(F.lit(0).alias("none")).alias("row"))


def proofs(tree: Tree, above: DataFrame) -> DataFrame:
    """(row, node, group_key, proof, top): every leaf with its siblings up to the top.

    ``above`` has (group_key, proof, top): how the groups' roots go on. Siblings pass down from
    round to round, a join of a block with its node in the round above, both unique there.
    """
    carried = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(tree.rounds):
        whole = blocks.join(carried, ["group_key", "block"])
        each = F.transform("members", lambda m, i: F.struct(
            m["place"].alias("place"), m["node"].alias("node"), m["row"].alias("row"),
            F.concat(_siblings(F.col("levels"), i, tree.arity, tree.depth), F.col("proof")).alias("proof")))
        out = whole.select("group_key", "top", F.inline(each))
        carried = out.select("group_key", "top", "proof", F.col("place").alias("block"))
    return out


def manifest(df: DataFrame, fields: Sequence[str], group: str, order: str, keep: Sequence[str] = (), arity: int = 2, block: int = BLOCK) -> DataFrame:
    """One row per row of ``df``: ``order``, ``keep``, leaf, subroot, root and proof.

    A leaf is the digest of the row's ``fields``. Leaves of a group (value of ``group``) ascend by
    ``order``; every ``arity`` consecutive nodes, the last run also fewer, become the digest of
    their concatenation, until one remains, the group's subroot. Subroots ordered by group (null
    first, then bytewise) lead to ``root`` in the same way. ``proof`` is an array of (left, right):
    what stands beside the node in its run, level by level up to the root; ``fold`` takes a leaf and
    its proof to the root.

    Rows go through one shuffle by ranges of (group, order) and one by blocks, as digests and kept
    columns only; whole texts are read in the scan. A group may hold any share of the rows.

    Nulls: a null field is ``-``, a null group is a group of its own, null ids come first. Rows of
    equal id are ordered by leaf, so repeated rows have a defined root; they are leaves of their own.
    Empty texts are fields of length 0. An empty table gives no rows. Other columns are not read.
    """
    kept = [F.col(f"`{c}`") for c in dict.fromkeys([order, *keep])]
    leaves = df.select(key_of(group).alias("group_key"), F.col(f"`{order}`").alias("id"), F.struct(*kept).alias("row"),
                       leaf_of([F.col(f"`{c}`") for c in fields]).alias("node"))
    tree = build_tree(with_places(leaves, "group_key", ["id", "node"]).drop("id"), arity, block)
    groups = tree.roots().select(F.lit("").alias("group_key"), "node", F.col("group_key").alias("name"), F.struct("group_key", "node").alias("row"))
    over = build_tree(with_places(groups, "group_key", ["name"]).drop("name"), arity, block)
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    tops = proofs(over, over.roots().select("group_key", nothing.alias("proof"), F.col("node").alias("top")))
    above = tops.select(F.col("row.group_key").alias("group_key"), "proof", F.struct(F.col("node").alias("subroot"), F.col("top").alias("root")).alias("top"))
    return proofs(tree, above).select("row.*", F.col("node").alias("leaf"), "top.subroot", "top.root", "proof")


def verify(listed: DataFrame, df: DataFrame, fields: Sequence[str], order: str) -> DataFrame:
    """The manifest's rows beside those of ``df`` now: id, leaf_now, folded_root, status.

    status: ``same``, ``changed`` (its leaf doesn't lead to the root), ``missing`` (only in the
    manifest), ``new`` (only in ``df``). Ids should be unique; equal ones are paired in order of
    their leaves.
    """
    now, proof, listed_id = df.select(F.col(f"`{order}`").alias("id"), leaf_of([F.col(f"`{c}`") for c in fields]).alias("leaf_now")), "proof", f"`{order}`"
    (salt,) = fresh(listed, "nth_at")
    nth = lambda d, leaf: with_places(d.withColumn("id_key", key_of("id")), "id_key", [leaf], salt, "total_at")
    old = nth(listed.select(F.col(listed_id).alias("id"), "leaf", "root", proof), "leaf")
    new = nth(now, "leaf_now").drop("id")
    both = old.drop("total_at").join(new.drop("total_at"), ["id_key", salt], "full")
    folded = fold(F.col("leaf_now"), F.col(proof))
    status = (F.when(F.col("leaf").isNull(), "new").when(F.col("leaf_now").isNull(), "missing")
              .when(folded == F.col("root"), "same").otherwise("changed"))
    name = F.when(F.col("id_key") != "-", F.substr("id_key", F.lit(2))).alias(order)
    return both.select(name, "leaf_now", F.when(F.col("leaf").isNotNull(), folded).alias("folded_root"), status.alias("status"))
