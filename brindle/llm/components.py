"""Connected components by repeated contraction, in DataFrame operations.

In each round every node points to the neighbour (or itself) that comes first under a hash that differs by round, the
edges are redrawn between what their ends point to, and loops and repeats go. The order is random, so the nodes fall
by a constant factor a round, long paths included. The pointers are composed at the end. Each round is written to the
shared folder, so a lost executor repeats one round at most; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of an edge; nodes with one root are connected. Null ends and loops are no edges."""
    with scratch(edges.sparkSession):
        now = materialise(_tidy(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), "edges")
        rounds: list[DataFrame] = []
        while not now.isEmpty():
            rank = F.xxhash64(F.lit(len(rounds)), F.col("b"))
            both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            best = both.groupBy("a").agg(F.min(F.struct(rank.alias("h"), F.col("b").alias("to"))).alias("m"))
            own = F.struct(F.xxhash64(F.lit(len(rounds)), F.col("a")).alias("h"), F.col("a").alias("to"))
            to = materialise(best.select(F.col("a").alias("node"), F.least("m", own).getField("to").alias("to")), "pointers")
            rounds.append(to)
            x = to.select(F.col("node").alias("a"), F.col("to").alias("pa"))
            y = to.select(F.col("node").alias("b"), F.col("to").alias("pb"))
            now = materialise(_tidy(now.join(x, "a").join(y, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))), "edges")
        # without a round, no edge is left to give a node
        last = rounds.pop().select("node", F.col("to").alias("root")) if rounds else now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        out = materialise(last, "roots", keep=not rounds)
        for to in reversed(rounds):
            later = out.select(F.col("node").alias("to"), "root")
            out = materialise(to.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root")), "roots", keep=to is rounds[0])
        return out


def _tidy(edges: DataFrame) -> DataFrame:
    """Each edge once, its smaller end first."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
