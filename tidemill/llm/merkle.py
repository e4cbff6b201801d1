"""A Merkle tree over rows: a subroot for each group, a root over the groups, and a proof for each row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sized

#: Nodes that one parent takes, and levels that one block of leaves collapses.
FAN, LEVELS = 16, 2
BLOCK = FAN**LEVELS


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length before it, so that neighbouring values cannot run together; `-` for null."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return digest(*map(field, values))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, run: digest(run["left"], node, run["right"]))


def siblings_digest(path: Column) -> Column:
    """sha256 of all siblings on a path, from the leaf's run up to the root's."""
    return F.sha2(F.array_join(F.transform(path, lambda run: F.concat(run["left"], run["right"])), "").cast("binary"), 256)


def _placed(rows: DataFrame) -> DataFrame:
    """rows (__group, __order, __node, __row, ...) with __pos, their place in the group, and __total, its rows.

    Range partitions follow the order, so a group of any size is spread; its rows
    before a partition are counted from one row for each partition and group.
    """
    by = [F.col(c).asc_nulls_first() for c in ("__group", "__order", "__node", "__row")]
    sorted_ = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    parts = sorted_.groupBy("__group", part.alias("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    group = Window.partitionBy("__group")
    parts = parts.select(
        F.col("__group").alias("__g"), "__part", "__first", (F.sum("__n").over(group.orderBy("__part")) - F.col("__n")).alias("__before"), F.sum("__n").over(group).alias("__total")
    )
    parts = sized(materialize(parts))
    joined = sorted_.join(parts, F.col("__group").eqNullSafe(F.col("__g")) & (part == F.col("__part")))
    return joined.withColumn("__pos", F.col("__at") - F.col("__first") + F.col("__before")).drop("__at", "__g", "__part", "__first", "__before", "__order", "__row")


def _parents(nodes: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FAN + 1, FAN), "").cast("binary"), 256))


def _blocks(nodes: DataFrame) -> DataFrame:
    """Blocks of BLOCK consecutive nodes of a group: their __members in order, and __tree, the levels from them to the block's root."""
    carried = [c for c in nodes.columns if c not in ("__group", "__pos", "__total", "__node")]
    members = F.sort_array(F.collect_list(F.struct("__pos", "__node", *carried)))
    grouped = nodes.groupBy("__group", F.floor(F.col("__pos") / BLOCK).alias("__block")).agg(F.max("__total").alias("__total"), members.alias("__members"))
    # A group of one node is done; one of up to FAN needs one level, and so on.
    depth = reduce(Column.__add__, [(F.col("__total") > FAN**k).cast("int") for k in range(LEVELS)])
    base = F.array(F.transform("__members", lambda m: m["__node"]))
    tree = F.when(depth == 0, base).otherwise(F.aggregate(F.sequence(F.lit(1), depth), base, lambda levels, _: F.array_append(levels, _parents(F.element_at(levels, -1)))))
    return materialize(grouped.withColumn("__tree", tree))


def _run(level: Column, index: Column) -> Column:
    """The siblings of the index-th node of a level."""
    first = index - index % FAN
    left, right = F.slice(level, first + 1, index - first), F.slice(level, index + 2, first + (FAN - 1) - index)
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def _children(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Each member of the blocks with its __path to the root, from the paths above (__g, __b, __tail) of the blocks' roots."""
    joined = blocks.join(above, F.col("__group").eqNullSafe(F.col("__g")) & (F.col("__block") == F.col("__b")))
    each = joined.select("__group", "__tree", "__tail", "__subroot", F.posexplode("__members").alias("__at", "__member"))
    runs = F.transform(
        F.slice("__tree", 1, F.size("__tree") - 1),
        lambda level, k: _run(level, F.floor(F.col("__at") / F.pow(F.lit(FAN), k)).cast("int")),
    )
    return each.select("__group", "__subroot", "__member.*", F.concat(runs, "__tail").alias("__path"))


def _forest(rows: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, leaves first, and the root of each group (__group, __node)."""
    nodes, rounds = _placed(rows), []
    while True:
        blocks = _blocks(nodes)
        rounds.append(blocks)
        nodes = blocks.select("__group", F.col("__block").alias("__pos"), F.ceil(F.col("__total") / BLOCK).alias("__total"), F.element_at(F.element_at("__tree", -1), 1).alias("__node"))
        most = nodes.agg(F.max("__total")).first()[0]
        if most is None or most <= 1:
            return rounds, nodes.select("__group", "__node")


def _paths(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The members of the first round's blocks with their __path; above: the path (__g, __tail, __subroot) of each group's root."""
    tails = above.withColumn("__b", F.lit(0).cast("long"))
    for blocks in reversed(rounds[1:]):
        below = _children(blocks, tails)
        tails = below.select(F.col("__group").alias("__g"), F.col("__pos").alias("__b"), F.col("__path").alias("__tail"), "__subroot")
    return _children(rounds[0], tails)


def manifest(rows: DataFrame, *, leaf_col: str = "leaf", group_col: str = "source", order_col: str = "doc_id") -> DataFrame:
    """Every row with its `path` to the root, its group's `subroot` and the `root` of all.

    Leaves of a group ascend by order_col (nulls first, ties by leaf). While a group has
    several nodes, every 16 consecutive ones become the sha256 of their digests; what
    remains is its subroot. Subroots, by group in ascending order (null first), give the root
    likewise. `path` lists the siblings (left, right) level by level: fold() makes the root of them.

    Leaves are cut into blocks of 256, whose levels array functions collapse; block
    roots are the nodes of the next round, so rounds grow with the logarithm of the
    rows, and no row ever holds more than a block. Other columns are carried through blocks:
    hand in narrow rows, not texts. Columns called path, subroot or root are replaced.
    Equal rows are leaves of their own; null leaves are not allowed; an empty table gives none.
    """
    carried = [c for c in rows.columns if c not in ("path", "subroot", "root", leaf_col)]
    kept = F.struct(*[F.col(c) for c in carried]).alias("__row_data")
    group_type = rows.schema[group_col].dataType
    # A number for each row tells equal rows apart, so that range partitions can cut between them.
    leaves = materialize(rows.select(F.col(group_col).alias("__group"), F.col(order_col).alias("__order"), F.col(leaf_col).alias("__node"), F.monotonically_increasing_id().alias("__row"), kept))
    rounds, subroots = _forest(leaves)
    top = subroots.select(F.lit(0).alias("__group"), F.col("__group").alias("__order"), "__node", F.lit(0).alias("__row"), F.col("__group").alias("__of"))
    tops, root = _forest(materialize(top))
    none = F.array().cast("array<struct<left: string, right: string>>")
    start = root.select(F.col("__group").alias("__g"), none.alias("__tail"), F.col("__node").alias("__subroot"))
    # On the way down from the root, __subroot is the root; below the subroots it is theirs, and the root goes along.
    groups = _paths(tops, start).select(
        F.col("__of").cast(group_type).alias("__g"), F.col("__path").alias("__tail"), F.struct(F.col("__node").alias("subroot"), F.col("__subroot").alias("root")).alias("__subroot")
    )
    out = _paths(rounds, groups)
    return out.select("__row_data.*", F.col("__node").alias(leaf_col), F.col("__path").alias("path"), "__subroot.subroot", "__subroot.root")
