"""Operator 11: Merkle manifest of a table, one tree per group under one root.

Every row is a leaf.  The leaves of a group, in id order, are joined ``fanout``
at a time until one node is left, the group's subroot; the subroots, in group
order, are joined likewise to the root.  Slot pivot: a parent's children are
spread into ``fanout`` slot columns by conditional aggregates.  Concatenating
the slots gives the parent's hash; the slots without a child's own one are its
siblings.

Work goes in rounds.  A round cuts the consecutive nodes of a group into blocks
of ``fanout ** levels`` (at most ``BLOCK``), shuffles and sorts once by (group,
block, place) and aggregates level by level in that order, so no further shuffle
or sort is needed; the rows of a block carry their siblings along.  A block's hash is a
node of the next round.  So the nodes of ``n`` leaves need
log(n) / log(BLOCK) shuffles, a hot group is spread over its blocks, and on the
way back every join is on (group, block), unique on both sides.

Defined cases: a null field is hashed as ``-``, so null differs from empty;
null ids come first; rows of equal id are ordered by leaf, equal rows stand side
by side; a null group is a group of its own, before all others; other columns
are not read, so they cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.index import with_global_index, with_group_index
from ..session import drop_scratch, scratch_path

FANOUT = 2
BLOCK = 256
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "struct<l:string,r:string>"


def digest(*parts: Column) -> Column:
    """H: lowercase hex sha256 of the parts one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A field as it enters a leaf: ``-`` or its UTF-8 byte count, ``:``, value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(fields: dict[str, Column]) -> Column:
    return digest(*[field(c) for c in fields.values()])


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf gives with its siblings, level by level."""
    return F.aggregate(path, start, lambda h, s: digest(s["l"], h, s["r"]))


def proof(path: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""))


def _written(df: DataFrame, name: str, made: list) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    made.append(path)
    return df.sparkSession.read.parquet(path)


def _levels(fanout: int) -> int:
    """Levels of a round: as many as a block of at most BLOCK nodes has, one at least."""
    n = 1
    while fanout ** (n + 1) <= BLOCK:
        n += 1
    return n


def _round(nodes: DataFrame, fanout: int) -> DataFrame:
    """(grp, block, hash, members) from nodes (grp, idx, hash): ``members`` are
    the nodes of the block, each with the siblings on its way to ``hash``."""
    levels = _levels(fanout)
    none = F.array().cast(f"array<{_STEP}>")
    # the place of a node in its block, digit by digit: one sort by all of them serves every level
    digits = [f"d{k}" for k in reversed(range(levels))]
    rows = nodes.select("grp", F.expr(f"idx div {fanout ** levels}").alias("block"), "hash",
                        F.array(F.struct("idx", none.alias("path"))).alias("members"),
                        *[F.expr(f"idx div {fanout ** k} % {fanout}").alias(f"d{k}") for k in reversed(range(levels))])
    rows = rows.repartition("grp", "block").sortWithinPartitions("grp", "block", *digits)
    while digits:
        *parent, slot = digits
        rows = rows.groupBy("grp", "block", *parent).agg(
            *[F.max(F.when(F.col(slot) == k, F.col("hash"))).alias(f"s{k}") for k in range(fanout)],
            *[F.first(F.when(F.col(slot) == k, F.col("members")), ignorenulls=True).alias(f"m{k}") for k in range(fanout)])
        # the first node of a group's first block has no sibling only if it is the last one left of the group
        alone = F.col("block") == 0
        for c in parent:
            alone = alone & (F.col(c) == 0)
        for k in range(1, fanout):
            alone = alone & F.col(f"s{k}").isNull()
        s = [F.coalesce(f"s{k}", F.lit("")) for k in range(fanout)]

        def climbed(k, s=s, alone=alone):
            step = F.struct(F.concat(F.lit(""), *s[:k]).alias("l"), F.concat(F.lit(""), *s[k + 1:]).alias("r"))
            up = F.transform(f"m{k}", lambda m: F.struct(m["idx"].alias("idx"), F.concat(m["path"], F.array(step)).alias("path")))
            return F.coalesce(F.when(alone, F.col(f"m{k}")).otherwise(up), F.array().cast(f"array<struct<idx:bigint,path:array<{_STEP}>>>"))
        rows = rows.select("grp", "block", *parent, F.when(alone, F.col("s0")).otherwise(digest(*s)).alias("hash"),
                           F.concat(*[climbed(k) for k in range(fanout)]).alias("members"))
        digits = parent
    return rows.select("grp", "block", "hash", "members")


def trees(nodes: DataFrame, made: list, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """All groups' trees over nodes (grp, idx, hash), idx contiguous from 0 in
    each group: the written rounds, bottom up, and (grp, root)."""
    if fanout < 2:
        raise ValueError("fanout must be 2 or more")
    rounds = []
    while True:
        rounds.append(_written(_round(nodes, fanout), "merkle-round", made))
        nodes = rounds[-1].select("grp", F.col("block").alias("idx"), "hash")
        if not nodes.where("idx > 0").limit(1).count():
            return rounds, nodes.select("grp", F.col("hash").alias("root"))


def descend(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """(grp, idx, path, kept...) of the lowest nodes: their siblings up to the
    root of ``top`` (grp, path, kept...), which has one row per group."""
    kept = [c for c in top.columns if c not in ("grp", "path")]
    above = top.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        rows = blocks.select("grp", "block", "members").join(above, ["grp", "block"])
        rows = rows.select("grp", F.col("path").alias("_up"), *kept, F.inline("members"))
        above = rows.select("grp", F.col("idx").alias("block"), F.concat("path", "_up").alias("path"), *kept)
    return above.withColumnRenamed("block", "idx")


def manifest(df: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields=FIELDS, fanout: int = FANOUT,
             tampered: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``df``: id, leaf, subroot, root, path (the siblings,
    level by level: left and right of the own slot) and ``check_leaf``, the leaf
    with the columns of ``tampered`` in place of the row's own (equal to leaf
    without it)."""
    made: list = []
    rows = df.select(*[F.col(c) for c in dict.fromkeys([*fields, id_col, group_col])])
    own = {c: F.col(c) for c in fields}
    # '' stands for the null group and '=...' for the others: same order, never null
    keyed = rows.select(F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("grp"),
                        F.col(id_col).alias("id"), leaf(own).alias("leaf"),
                        F.nullif(leaf({**own, **(tampered or {})}), leaf(own)).alias("other"))
    # all columns are keys: rows that tie are equal, and nothing has to be joined back
    leaves = _written(with_group_index(keyed, ["grp"], ["id", "leaf", "other"], "idx"), "merkle-leaves", made)
    rounds, subroots = trees(leaves.select("grp", "idx", F.col("leaf").alias("hash")), made, fanout)
    subroots = _written(with_global_index(subroots.withColumnRenamed("root", "subroot"), ["grp", "subroot"], "pos"), "merkle-subroots", made)
    one = F.substr("grp", F.lit(1), F.lit(0))            # one group; a literal would be no key to partition by
    over, root = trees(subroots.select(one.alias("grp"), F.col("pos").alias("idx"), F.col("subroot").alias("hash")), made, fanout)
    top = descend(over, root.withColumn("path", F.array().cast(f"array<{_STEP}>")))
    top = top.select(F.col("idx").alias("pos"), "path", "root").join(subroots, "pos").drop("pos")
    paths = descend(rounds, top)
    out = paths.join(leaves, ["grp", "idx"])
    out = _written(out.select(F.col("id").alias(id_col), "leaf", "subroot", "root", "path",
                              F.coalesce("other", "leaf").alias("check_leaf")), "merkle", made)
    drop_scratch(df.sparkSession, *made[:-1])
    return out


def verify(made: DataFrame) -> DataFrame:
    """Rows of ``manifest`` with proof_sha256, folded_root and verified."""
    folded = made.select("*", proof(F.col("path")).alias("proof_sha256"), fold(F.col("check_leaf"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
