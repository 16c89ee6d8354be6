"""Connected components of an edge table, by contraction.

Every round each node moves to its smallest neighbour (by id in the first round,
by a fresh hash order later, so chains shrink by a constant factor too); edges
are rewritten to the moved ends, and the rounds end when no edge is left. Only
aggregations with map-side combining and equi-joins run; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the
    smallest node reachable. Null ends and loops link nothing; repeats are fine."""
    edges = edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    left = materialize(edges.distinct(), "edges")
    moves: list[DataFrame] = []
    turn = 0
    while turn == 0 or not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = (lambda c: c) if turn == 0 else (lambda c, seed=turn: F.xxhash64(c, F.lit(seed)))
        best = both.groupBy("a").agg(F.min(F.struct(rank(F.col("b")).alias("k"), F.col("b").alias("b"))).alias("best"))
        own = F.struct(rank(F.col("a")).alias("k"), F.col("a").alias("b"))
        move = materialize(best.select(F.col("a").alias("node"), F.least("best", own)["b"].alias("to")), "moves")
        moves.append(move)
        one, two = move.toDF("a", "a2"), move.toDF("b", "b2")
        moved = left.join(one, "a").join(two, "b").where("a2 <> b2")
        left = materialize(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
        turn += 1
    at = moves[0].toDF("node", "root")
    for move in moves[1:]:
        at = at.join(move.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    at = materialize(at, "roots")
    smallest = at.groupBy("root").agg(F.min("node").alias("component"))
    return at.join(smallest, "root").select("node", "component")
