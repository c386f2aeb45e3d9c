"""Connected components of a distributed edge table.

Alternates the large-star and small-star steps until the edges no longer
change: every node then points at the smallest node of its component. Edges
stay in DataFrames; each round is written to the shared scratch folder, which
cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpimart.session import scratch_dir


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of an edge (two long columns); the
    component is its smallest node."""
    spark = edges.sparkSession
    schema = "u long, v long"

    def kept(df: DataFrame) -> tuple[DataFrame, tuple]:
        path = scratch_dir(spark, "components")
        df.select("u", "v").write.parquet(path)
        out = spark.read.schema(schema).parquet(path)
        state = out.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20))))
        return out, tuple(state.first())

    now, state = kept(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v").distinct())
    while True:
        if not state[0]:
            break
        now, after = kept(_small_star(_large_star(now)))
        if after == state:
            break
        state = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
