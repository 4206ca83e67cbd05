"""Merkle manifest of a table: leaves per row, a tree per group, a tree over the groups.

Slot pivot: conditional aggregates spread the children of each parent into one column per slot; the columns
concatenated and hashed are the parent, and the columns without a child's own slot are its siblings. A few levels
are climbed at a time: the nodes of a block lie in one task, and a parent keeps its slots with those of its children
nested in them, so that a leaf's way up is unfolded again without a join per level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthpanel.llm.store import saved

FANOUT = 3
LEVELS = 5
"""Levels climbed per shuffle; a block holds FANOUT ** LEVELS nodes, which bounds its row."""


def digest(text: Column) -> Column:
    """Lowercase hex sha256 of a text's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as it enters a leaf: `-` for null, else its UTF-8 bytes counted, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: list[Column]) -> Column:
    """Digest of all values of a row."""
    return digest(F.concat(*[field(v) for v in values]))


def positions(rows: DataFrame, order: list[str], group: str = "grp") -> DataFrame:
    """`rows` with `pos` (gapless from 0 within each value of `group`, by `order`) and `n` (rows of the group).

    Rows are dealt by ranges of group and order and numbered where they lie; a group of any size is spread over as
    many tasks as it fills. Only counts per task and group are summed along a group. Rows equal in `order` get
    their places in any order. The group must not be null.
    """
    dealt = rows.repartitionByRange(*[F.col(c) for c in (group, *order)]).sortWithinPartitions(group, *order)
    place = F.monotonically_increasing_id()
    dealt = saved(dealt.withColumn("_place", place), "ordered").withColumn("_part", F.shiftright("_place", 33))
    counts = dealt.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    whole = Window.partitionBy(group)
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    starts = saved(counts.select(group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("n")), "starts")
    return dealt.join(starts, [group, "_part"]).withColumn("pos", F.col("_place") + F.col("_shift")).drop("_place", "_part", "_shift")


def _climb(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Blocks of nodes (grp, pos, n, node with `hash`): grp, pos of the block, n as before, node (the top, nested).

    A group that has one node left passes it on as it is.
    """
    rows = nodes.withColumn("block", F.floor(F.col("pos") / F.lit(fanout ** levels)))
    rows = rows.repartition("grp", "block")
    for level in range(levels):
        slot = F.pmod(F.col("pos"), F.lit(fanout))
        # Every slot holds at most one child.
        pivot = [F.first(F.when(slot == s, F.col("node")), ignorenulls=True).alias(f"s{s}") for s in range(fanout)]
        parents = rows.groupBy("grp", "block", "n", F.floor(F.col("pos") / F.lit(fanout)).alias("up")).agg(*pivot)
        joined = F.concat(*[F.coalesce(F.col(f"s{s}.hash"), F.lit("")) for s in range(fanout)])
        many = F.col("n") > F.lit(fanout ** level)
        hashed = F.when(many, digest(joined)).otherwise(F.col("s0.hash"))
        node = F.struct(hashed.alias("hash"), F.array(*[F.col(f"s{s}") for s in range(fanout)]).alias("slots"))
        rows = parents.select("grp", "block", "n", F.col("up").alias("pos"), node.alias("node"))
    return rows.select("grp", "pos", "n", "node")


def _unfold(blocks: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Blocks (grp, pos, n, node, path of the top) to their nodes (grp, pos, n, node, path), paths from below to the root.

    A step of a path has the siblings before and after, each as one text.
    """
    rows = blocks
    for level in reversed(range(levels)):
        spread = rows.select("grp", "pos", "n", "path", F.col("node.slots.hash").alias("hashes"), F.posexplode("node.slots").alias("slot", "child"))
        side = lambda low, count: F.array_join(F.slice("hashes", low, count), "")  # absent slots are null and left out
        step = F.struct(side(F.lit(1), F.col("slot")).alias("before"), side(F.col("slot") + 2, F.lit(fanout)).alias("after"))
        many = F.col("n") > F.lit(fanout ** level)
        rows = spread.filter("child is not null").select(
            "grp", (F.col("pos") * fanout + F.col("slot")).alias("pos"), "n", F.col("child").alias("node"),
            F.when(many, F.concat(F.array(step), F.col("path"))).otherwise(F.col("path")).alias("path"))
    return rows


def _tree(nodes: DataFrame, fanout: int, levels: int) -> tuple[DataFrame, list[DataFrame]]:
    """The one node left of each group (grp, hash), and the saved blocks of each climb, the lowest first."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    climbs, width = [], 1
    while not climbs or most > width:
        climbs.append(saved(_climb(nodes, fanout, levels), f"blocks_{len(climbs)}"))
        nodes = climbs[-1].select("grp", "pos", F.ceil(F.col("n") / F.lit(fanout ** levels)).cast("bigint").alias("n"),
                                  F.struct("node.hash").alias("node"))
        width *= fanout ** levels
    return nodes.select("grp", "node.hash"), climbs


def _paths(tops: DataFrame, climbs: list[DataFrame], fanout: int, levels: int) -> DataFrame:
    """Nodes at the bottom of the climbs with their paths; `tops` has grp and the path above each group."""
    above = tops.withColumn("pos", F.lit(0).cast("bigint"))
    for blocks in reversed(climbs):
        rows = _unfold(blocks.join(above, ["grp", "pos"]), fanout, levels)
        above = rows.select("grp", "pos", "path")
    return rows


def manifest(docs: DataFrame, columns: list[str], group: str, key: str, changed: dict[str, Column] | None = None,
             when: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row per row of `docs`: key, leaf, tampered leaf, subroot, root and path (before, after per level, from below).

    A leaf is the digest of all `columns`. Leaves of a group ascend by `key` (nulls first, equal keys by their leaf);
    while several nodes remain, each `fanout` neighbours become the digest of their digests, the last run also if it
    is shorter. The groups' last nodes, ordered by `group` (null first, then by UTF-8 bytes), likewise give the root.
    `changed` replaces columns where `when` holds; the digest of that version is the tampered leaf, which is the leaf
    elsewhere. Texts are read once and stay where they are read; only digests are shuffled.

    Null values and null groups are values of their own. Empty texts count 0 bytes. Repeated rows have equal leaves
    and places side by side. No rows give no rows. Columns of other names are ignored.
    """
    col = lambda c: F.col(f"`{c}`")
    leaf = leaf_digest([col(c) for c in columns])
    other = leaf_digest([(changed or {}).get(c, col(c)) for c in columns])
    tampered = F.when(when, other) if when is not None else F.lit(None).cast("string")
    # "=" keeps the empty name apart from null, which comes first.
    grp = F.coalesce(F.concat(F.lit("="), col(group).cast("string")), F.lit(""))
    leaves = saved(docs.select(grp.alias("grp"), col(key).alias("key"), leaf.alias("hash"), tampered.alias("tampered")), "leaves")
    nodes = positions(leaves, ["key", "hash"]).select("grp", "pos", "n", F.struct("hash", "key", "tampered").alias("node"))
    subroots, climbs = _tree(nodes, fanout, levels)
    subroots = saved(subroots, "subroots")
    upper = positions(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "hash"), ["name"])
    root, over = _tree(upper.select("grp", "pos", "n", F.struct("hash", "name").alias("node")), fanout, levels)
    empty = F.array().cast("array<struct<before:string,after:string>>")
    tops = _paths(root.select("grp", empty.alias("path")), over, fanout, levels)
    tops = saved(tops.select(F.col("node.name").alias("grp"), F.col("node.hash").alias("subroot"), "path"), "tops")
    rows = _paths(tops.select("grp", "path"), climbs, fanout, levels)
    last = root.first()
    named = tops.select("grp", "subroot", F.lit(last.hash if last else None).cast("string").alias("root"))
    return rows.join(named, "grp").select(
        F.col("node.key").alias("key"), F.col("grp"), F.col("node.hash").alias("leaf"),
        F.coalesce("node.tampered", "node.hash").alias("tampered"), "subroot", "root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, step: digest(F.concat(step["before"], acc, step["after"])))


def proof(path: Column) -> Column:
    """Digest of all siblings on a path, from below, left to right."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""))


def judge(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root, proof and the check of every row of `documents`.

    Where 2 divides the unsigned crc32 of the decimal doc_id, the row is tampered with: the text loses its line
    breaks. Rows without a doc_id or a text stay as they are. verified tells whether the leaf at hand and the
    original siblings fold to the root; it is false only where a text had line breaks to lose.
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id",
                    {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}, hit)
    rows = rows.withColumns({"proof_sha256": proof(F.col("path")), "folded_root": folded(F.col("tampered"), F.col("path"))})
    return rows.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))
