"""Connected components by repeated contraction, with no hub in one task.

Every round sends each node to the neighbour (or itself) with the smallest
seeded hash, then maps the edges.  A round drops a constant share of the nodes
on average whatever the shape, so long chains end in logarithmic rounds.  Group
minima are combined map-side; joins on a hub have both sides dealt straight from
written tables, so that adaptive execution can split the hub's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import Workspace


def connected_components(edges: DataFrame, ws: Workspace, seed: int = 11) -> DataFrame:
    """Smallest id reachable from every node that has an edge.

    Parameters
    ----------
    edges : columns ``a`` and ``b`` (long).  Direction, repeated edges and loops
        do not matter; an edge with a null end is ignored.  An empty table gives
        an empty result.

    Returns a written table ``(id, component)``.
    """
    found = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    both = found.union(found.select(F.col("b"), F.col("a"))).distinct()
    live, maps = ws.save(both, "edges"), []
    rank = lambda c, k: F.struct(F.xxhash64(c, F.lit(seed + k)).alias("h"), c.alias("v"))
    while live.limit(1).count():
        k = len(maps)
        near = live.groupBy("a").agg(F.min(rank(F.col("b"), k)).alias("m"))
        step = near.select(F.col("a").alias("id"), F.least("m", rank(F.col("a"), k))["v"].alias("to"))
        step = ws.save(step, f"map{k}")
        maps.append(step)
        left = step.select(F.col("id").alias("a"), F.col("to").alias("ta"))
        right = step.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        moved = live.join(left, "a").select("b", "ta").join(right, "b").where("ta <> tb")
        nxt = ws.save(moved.select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct(), f"edges{k + 1}")
        ws.drop(live)
        live = nxt
    if not maps:
        return ws.save(live.select(F.col("a").alias("id"), F.col("b").alias("component")), "components")
    # One chain of joins follows every node through all rounds; each join has its own exchanges.
    root = maps[0]
    for k, step in enumerate(maps[1:]):
        far = step.select(F.col("id").alias("to"), F.col("to").alias(f"to{k}"))
        root = root.join(far, "to", "left").select("id", F.coalesce(f"to{k}", "to").alias("to"))
    root = ws.save(root, "roots")
    least = ws.save(root.groupBy("to").agg(F.min("id").alias("component")), "least")
    return ws.save(root.join(least, "to").select("id", "component"), "components")
