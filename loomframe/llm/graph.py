"""Connected components of an edge table, by smallest reachable id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: Edges of a node that one task joins, about.
SHARE = 4096


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) to (node, label): the smallest id that each node reaches. Nodes without an edge are absent.

    Labels move over edges and then jump to the label of the label, until a round changes none: labels only fall, so that
    comes, in about the logarithm of the diameter. Every round is a table in the shared folder. A node's edges lie with their
    source, dealt in shares of SHARE edges by hash, so a node with very many edges is spread: its label goes
    to its shares, and what they find is combined before the shuffle.
    """
    # written once: both directions must be of the same edges, even if the source gives others when asked again
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    both = edges.union(edges.select("b", "a"))
    degree = both.groupBy("b").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    dealt = both.join(degree, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("shares")).cast("int").alias("share"), "shares")
    both = materialize(dealt, "edges")
    release(edges)
    shares = both.groupBy(F.col("b").alias("node")).agg(F.max("shares").alias("shares"))
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    label = materialize(least.join(shares, "node").select("node", F.least("node", "m").alias("label"), "shares"), "labels")
    while True:
        sent = label.select(F.col("node").alias("b"), "label", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
        near = both.select("a", "b", "share").join(sent, ["b", "share"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        moved = label.join(near, "node").select("node", "label", "shares", F.least("label", "m").alias("to"))
        jump = moved.select(F.col("node").alias("to"), F.col("to").alias("further"))
        moved = moved.join(jump, "to").select("node", F.col("label").alias("old"), F.least("to", "further").alias("label"), "shares")
        before, moved = label, materialize(moved, "labels")
        release(before)
        label = moved.select("node", "label", "shares")
        if not moved.where("label <> old").limit(1).count():
            release(both)
            return label.drop("shares")
