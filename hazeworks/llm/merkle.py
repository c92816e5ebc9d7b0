"""Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups' subroots, and for each row the proof that leads to the root.

1. Leaves are digests of the rows' columns (``leaf``). They are written once, range-partitioned by (group, key) and numbered: ``row_number``
   within a partition's share of a group, plus the counts of the shares before. A group that holds most rows is many shares.
2. Level by level, the index divided by the fanout groups nodes into runs; a run's sorted children are hashed into its parent. Groups that
   have come down to one node leave: that node is their subroot. Every level is a fanout-th of the one below.
3. The subroots, ordered by group, are numbered and folded the same way into the root.
4. From the root down, a join by level gives each run its parent's proof, and each child of it that proof with its own siblings in front.
   So the proof that sixteen nodes share travels once, and only leaves have whole ones, within the last stage.

Nulls: a null column is ``-`` in the leaf; rows of null group are a group of their own, the first; null keys come first in their group. Rows
of equal key are ordered by leaf, equal rows in any order, each with its own place. Empty and very long texts are values like any others. A
lone leaf is its group's subroot, a lone subroot the root; a row without any sibling has an empty proof. An empty table gives an empty result.
Columns of any name may be hashed or carried; others are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeworks.llm.common import materialize

FANOUT = 16
#: Proof of a node: for each level from its own up, its run's siblings to the left and to the right, their digests joined.
PROOF = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """A value that says where it ends: its UTF-8 byte count, a colon, its text; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest (lower-case hex SHA-256) of a row's values."""
    return F.sha2(F.concat(*map(field, values)), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that follows from a leaf and a proof."""
    return F.aggregate(proof, start, lambda h, level: F.sha2(F.concat(level["left"], h, level["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of a proof's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda level: F.array(level["left"], level["right"]))), ""), 256)


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``i``, the place of each row in its group ``g`` from 0 on by ``order``, and ``n``, the group's rows."""
    placed = materialize(df.repartitionByRange("g", *order).withColumn("part", F.spark_partition_id()), "merkle-ranges")
    shares = placed.groupBy("g", "part").agg(F.count("*").alias("rows"))
    whole = Window.partitionBy("g")
    before = F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = shares.select("g", "part", before.alias("before"), F.sum("rows").over(whole).alias("n"))
    within = F.row_number().over(Window.partitionBy("g", "part").orderBy(*order))
    return placed.withColumn("r", within).join(starts, ["g", "part"]).withColumn("i", F.col("before") + F.col("r") - 1).drop("part", "r", "before", "row")


def _grown(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Per level the runs (g, i, n, children) of groups with several nodes, and the last nodes (g, i, h) of those that have one.

    ``nodes`` has g, i, n (nodes of the group), h and what else the children carry.
    """
    runs, tops = [], []
    while True:
        nodes = nodes if runs else materialize(nodes, "merkle-nodes")
        tops.append(nodes.where("n = 1"))
        if nodes.where("n > 1").isEmpty():
            return runs, tops
        child = F.struct("i", "h", *(c for c in nodes.columns if c not in ("g", "i", "n", "h")))
        run = [F.col("g"), F.expr(f"i div {fanout}").alias("i"), F.expr(f"(n + {fanout} - 1) div {fanout}").alias("n")]
        level = nodes.where("n > 1").groupBy(*run).agg(F.sort_array(F.collect_list(child)).alias("children"))
        runs.append(materialize(level, "merkle-runs"))
        nodes = runs[-1].select("g", "i", "n", F.sha2(F.array_join("children.h", ""), 256).alias("h"))


def _handed_down(runs: list[DataFrame], tops: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """Leaves with their proofs. ``above`` has for each group its subroot's ``proof`` and what else all its leaves get."""
    given = [c for c in above.columns if c != "g"]
    top = lambda level: tops[level].join(above, "g").drop("n")
    found = top(len(runs))
    for level in range(len(runs) - 1, -1, -1):
        digests = F.col("children.h")
        joined = lambda start, most: F.array_join(F.slice(digests, start, most), "")  # noqa: E731, B023
        beside = lambda x, j: F.struct(x.alias("x"), F.struct(joined(F.lit(1), j).alias("left"), joined(j + 2, F.lit(fanout)).alias("right")).alias("own"))  # noqa: E731, B023
        each = runs[level].drop("n").join(found.select("g", "i", *given), ["g", "i"]).select("g", *given, F.explode(F.transform("children", beside)).alias("c"))
        proof = F.concat(F.array("c.own"), "proof").cast(PROOF).alias("proof")
        found = each.select("g", "c.x.*", proof, *(c for c in given if c != "proof")).unionByName(top(level))
    return found


def manifest(docs: DataFrame, columns: list[str], group: str, key: str, fanout: int = FANOUT, carried: dict[str, Column] | None = None) -> DataFrame:
    """Per row: ``key`` (the key column), ``group``, ``leaf``, ``place`` in its group, ``proof``, ``subroot``, ``root`` and the ``carried`` values."""
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    more = carried or {}
    # Groups as text that sorts bytewise, null first.
    name = F.coalesce(F.concat(F.lit("="), quoted(group).cast("string")), F.lit(""))
    hashed = docs.select(name.alias("g"), quoted(key).alias("k"), quoted(group).alias("s"), leaf(*map(quoted, columns)).alias("h"), F.struct(F.lit(0).alias("_"), *(v.alias(c) for c, v in more.items())).alias("x"))
    leaves = materialize(hashed.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    runs, tops = _grown(_numbered(leaves, ["k", "h", "row"]), fanout)

    subroots = tops[0].select("g", "h")
    for level in tops[1:]:
        subroots = subroots.union(level.select("g", "h"))
    named = subroots.select(F.lit("").alias("g"), F.col("g").alias("of"), "h")
    upper_runs, upper_tops = _grown(_numbered(named, ["of"]), fanout)
    root = upper_tops[-1].select("g", F.array().cast(PROOF).alias("proof"), F.col("h").alias("root"))
    above = _handed_down(upper_runs, upper_tops, root, fanout).select(F.col("of").alias("g"), "proof", F.col("h").alias("subroot"), "root")
    found = _handed_down(runs, tops, materialize(above, "merkle-subroots"), fanout)
    return found.select(F.col("k").alias("key"), F.col("s").alias("group"), F.col("h").alias("leaf"), F.col("i").alias("place"), "proof", "subroot", "root", *(F.col(f"x.`{c}`").alias(c) for c in more))


def verified(rows: DataFrame, leaf_column: str = "leaf") -> DataFrame:
    """Adds ``folded_root``, what the rows' leaves and proofs lead to, and ``verified``, whether that is the root."""
    return rows.withColumn("folded_root", fold(F.col(leaf_column), F.col("proof"))).withColumn("verified", F.col("folded_root") == F.col("root"))
