"""Merkle manifest of a table of documents: leaf, roots and inclusion proof of every row.

A leaf is the digest of a row's fields. Per source the leaves ascend by document id; every 16
consecutive nodes have a parent, up to the source's subroot, and the subroots of all sources are
the leaves of the tree that ends in the root.

1. Ranks: rows (digests, no texts) are range partitioned by source and id and written once; the
   rank of a row is its place in its partition behind the counts of the partitions before. Equal
   keys are spread by a random number, so many copies of a row or null ids fill no task alone.
2. Nested-struct rollup: a rank's digits in base 16 are its path. Within a block of 4096 ranks the
   last digit is grouped away, then the one before, then the third; each grouping nests the
   children's structs in their parent's. A block is one row of bounded size, whatever the source.
3. The roots of a source's blocks are nodes of the next tree, by the same steps, until one is left.
   Only these (one row for 4096) are joined back, as the path above the block.
4. Transform and explode: a block's structs are unfolded again, and each level's siblings go along
   as two texts, those to the left and those to the right. A leaf's proof is the list of these.

Every field is `-` if null, else its length in UTF-8 bytes, `:` and its value; empty text is `0:`.
Null sources are one source, which comes first; null ids come before others and are never tampered
with. Rows that share source and id go by their leaf; equal rows are leaves of their own. Texts are
read whole, and only their digests are shuffled. Other columns are ignored. An empty table gives an
empty result. Ids and n_chars are whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylog.llm.shared import cut

FAN, DIGITS = 16, 3
BLOCK = FAN**DIGITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of offsets that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
PATH = "array<struct<l:string,r:string>>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def field_text(value: Column) -> Column:
    """`-` for null, else byte count, `:` and the value."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf_digest(fields: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field_text(fields[name]) for name in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, branch (the source's field text), leaf, and shown: the leaf of the row as it is found
    at the check, where one in five texts was lower-cased."""
    fields = {name: F.col(name) for name in FIELDS}
    number = F.col("doc_id").cast("long")
    chosen = F.crc32(number.cast("string").cast("binary")) % 5 == 0
    lowered = leaf_digest({**fields, "text": F.translate("text", CAPITALS, CAPITALS.lower())})
    return docs.select(
        number.alias("doc_id"),
        field_text(F.col("source")).alias("branch"),
        leaf_digest(fields).alias("leaf"),
        F.when(chosen, lowered).alias("tampered"),
    ).select("doc_id", "branch", "leaf", F.coalesce("tampered", "leaf").alias("shown"))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with rank (from 0, within `branch`, by `order`) and n, the branch's rows. `order`
    keeps the rows of a branch together."""
    by = [*order, F.col("_salt")]
    placed = cut(rows.withColumn("_salt", F.rand(11)).repartitionByRange(*by).sortWithinPartitions(*by).drop("_salt"))
    # the written placement is settled, so a row's number tells its partition and its place there
    numbered = placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    parts = numbered.groupBy("branch", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("branch")
    before = F.sum("_n").over(whole.orderBy("_part")) - F.col("_n")
    offsets = cut(
        parts.select("branch", "_part", (before - F.col("_first")).alias("_offset"), F.sum("_n").over(whole).alias("n"))
    )
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    found = numbered.join(offsets, ["branch", "_part"]).withColumn("rank", F.col("_at") + F.col("_offset"))
    return found.drop("_at", "_part", "_offset")


def _digest(children: Column) -> Column:
    return F.sha2(F.array_join(F.transform(children, lambda c: c["node"]), ""), 256)


def rollup(nodes: DataFrame) -> DataFrame:
    """Blocks of nodes (branch, n, rank, node and others): branch, n, block, node (of the block's
    root) and children, nested in DIGITS levels. A level above a branch's only node adds none."""
    digit = [F.expr(f"cast(rank div {FAN**k} % {FAN} as int)").alias(f"d{k}") for k in range(DIGITS)]
    keys = ["branch", "n", "block"]
    inner = [c for c in nodes.columns if c not in ("branch", "n", "rank")]
    # dealt out by block once; each grouping below keeps that
    rows = nodes.select("branch", "n", F.expr(f"rank div {BLOCK}").alias("block"), *digit, *inner).repartition("branch", "block")
    for k in range(DIGITS):
        rest = [f"d{j}" for j in range(DIGITS - 1, k, -1)]
        child = F.struct(f"d{k}", *inner)
        rows = rows.groupBy(*keys, *rest).agg(F.sort_array(F.collect_list(child)).alias("children"))
        node = F.when(F.col("n") > FAN**k, _digest(F.col("children"))).otherwise(F.col("children")[0]["node"])
        rows = rows.withColumn("node", node)
        inner = ["node", "children"]
    return rows


def _siblings(digests: Column, place: Column) -> Column:
    """The digests before and behind a place, each as one text."""
    left = F.array_join(F.slice(digests, F.lit(1), place), "")
    right = F.array_join(F.slice(digests, place + 2, F.lit(FAN)), "")
    return F.struct(left.alias("l"), right.alias("r"))


def unfolded(blocks: DataFrame, inner: list[str], above: list[str]) -> DataFrame:
    """The nodes of blocks (as `rollup` makes them, with `path` from the block's root on): branch,
    rank, `inner` columns, `above` columns and path, from the node on."""
    rows = blocks.select("branch", "n", (F.col("block") * BLOCK).alias("rank"), "children", "path", *above)
    for k in reversed(range(DIGITS)):
        nodes = rows.withColumn("_digests", F.transform("children", lambda c: c["node"]))
        each = nodes.select(
            "branch", "n", "rank", "path", *above, "_digests", F.posexplode("children").alias("_place", "_child")
        )
        step = F.when(F.col("n") > FAN**k, F.array(_siblings(F.col("_digests"), F.col("_place"))))
        rows = each.select(
            "branch", "n", (F.col("rank") + F.col("_place") * FAN**k).alias("rank"), *above,
            F.concat(F.coalesce(step.cast(PATH), F.array().cast(PATH)), "path").alias("path"),
            *([F.col("_child.children").alias("children")] if k else [F.col(f"_child.{c}").alias(c) for c in inner]),
        )
    return rows.drop("n")


def proved(nodes: DataFrame, over: Callable[[DataFrame], DataFrame], above: list[str]) -> DataFrame:
    """The nodes (branch, n, rank, node and others) with their path up to the branch's root and on
    by `over`, which gives branch, path and the `above` columns of the roots (branch, node)."""
    inner = [c for c in nodes.columns if c not in ("branch", "n", "rank")]
    blocks = cut(rollup(nodes))
    if blocks.where(F.col("n") > BLOCK).isEmpty():
        joined = blocks.join(over(blocks.select("branch", "node")), "branch")
    else:
        parents = blocks.select("branch", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("rank"), "node")
        upper = proved(parents, over, above).select("branch", F.col("rank").alias("block"), "path", *above)
        joined = blocks.join(upper, ["branch", "block"])
    return unfolded(joined, inner, above)


def _over_sources(subroots: DataFrame) -> DataFrame:
    """branch, subroot, root and the path between them."""
    # a field text's value, null for the null source, which sorts first; strings compare bytewise
    source = F.when(F.col("source") != "-", F.expr("substring(source, instr(source, ':') + 1)"))
    rows = subroots.select(F.lit("all").alias("branch"), F.col("branch").alias("source"), "node")
    nodes = ranked(rows, [source.asc_nulls_first()])
    ends = lambda tops: tops.select("branch", F.array().cast(PATH).alias("path"), F.col("node").alias("root"))
    found = proved(nodes, ends, ["root"])
    return found.select(F.col("source").alias("branch"), "path", F.col("node").alias("subroot"), "root")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from the leaf as found and the proof)
    and verified of every row."""
    rows = cut(leaves(docs))
    source = F.when(F.col("branch") != "-", F.expr("substring(branch, instr(branch, ':') + 1)"))
    nodes = ranked(rows, [source.asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")])
    found = proved(nodes.withColumnRenamed("leaf", "node"), _over_sources, ["subroot", "root"])
    proof = F.array_join(F.transform("path", lambda p: F.concat(p["l"], p["r"])), "")
    folded = F.aggregate("path", F.col("shown"), lambda node, p: F.sha2(F.concat(p["l"], node, p["r"]), 256))
    return found.select(
        "doc_id", F.col("node").alias("leaf"), "subroot", "root",
        F.sha2(proof, 256).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
