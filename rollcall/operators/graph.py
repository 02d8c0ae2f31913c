"""Graph operators: connected components by alternating stars, which keep every step a shuffle join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.storage import materialize, release


def _checksum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row.n, int(row.h or 0)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 50) -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is the smallest node reachable.

    Large-star and small-star rounds alternate until the edge set is a set of stars. A hub's minimum is combined
    before the shuffle, and the join that hands it to the hub's neighbours can be split when it is skewed. Self-loops
    give their node a component of its own; edges with a null end are ignored; no edges give no rows. If `rounds` do not
    suffice, which for n nodes takes some log2(n) of them, it raises an error.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    loops = e.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    e = materialize(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = _checksum(e)
    for _ in range(rounds if before[0] else 0):
        older = e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(low.select("u", F.col("m").alias("v")).unionByName(moved).distinct(), "cc")
        after = _checksum(e)
        if after == before:
            break
        release(older)
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components are not settled after {rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
