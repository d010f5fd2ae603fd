"""Connected components of an edge table by alternating star contraction, all on the cluster.

Large-star links every larger neighbour of a node to the smallest one it knows, small-star does so
for the smaller neighbours; both keep the components and end in stars (Kiveris et al., 2014).  The
minima are pre-aggregated and written before they are joined back, so that Spark can split a hub's
rows over many tasks; nothing but counts and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.llm.common import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch, *, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable; only nodes with an edge are in it.

    Rounds grow with the logarithm of the longest path; more than ``max_rounds`` raise, and drop nothing.
    """
    one = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = scratch.save(f"{name}-0", edges.where("u is not null and v is not null and u <> v").select(*one).distinct())
    last = f"{name}-0"
    state = _state(now)
    for k in range(1, max_rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(f"{name}-{k}a", both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(f"{name}-{k}b", large)
        least2 = scratch.save(f"{name}-{k}c", large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = scratch.save(f"{name}-{k}", small.unionByName(least2.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(last, f"{name}-{k}a", f"{name}-{k}b", f"{name}-{k}c")
        now, last = following, f"{name}-{k}"
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
