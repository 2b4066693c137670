"""Connected components of links, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallylog.llm.shared import cut, split_join


def connected(links: DataFrame) -> DataFrame:
    """(node, label) of every node of the links (columns a and b, any type with an order): the
    label is the least node that can be reached.

    Each round a node hands its smaller neighbours to the least of them, its parent, and all move on
    to the parent's own parent, so paths are halved; it ends when nothing moves. A round is five
    shuffles and one write to the shared folder. Parents are found with partial aggregates, so a
    node with very many links is no hot key there; the joins on it are split by Spark. Links of a
    node to itself make it a component of its own; null ends are ignored.
    """
    ends = links.where("a is not null and b is not null")
    ends = cut(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    pairs = ends.where("u <> v")
    while True:
        parent = pairs.groupBy("u").agg(F.min("v").alias("m"))
        handed = split_join(pairs.select("u", "v"), parent, ["u"]).select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
            F.col("m").alias("v"),
            (F.col("v") != F.col("m")).alias("moved"),
        )
        grand = parent.select(F.col("u").alias("v"), F.col("m").alias("g"))
        hopped = split_join(handed, grand, ["v"], "left").select(
            "u", F.coalesce("g", "v").alias("v"), (F.col("moved") | F.col("g").isNotNull()).alias("moved")
        )
        seen = Observation()
        now = hopped.groupBy("u", "v").agg(F.max("moved").alias("moved"))
        pairs = cut(now.observe(seen, F.max(F.col("moved").cast("int")).alias("moved")))
        if not seen.get["moved"]:
            break
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    alone = ends.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("label"))
    found = pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
    return found.unionByName(alone.join(found, "node", "left_anti"))
