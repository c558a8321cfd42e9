"""Connected components of a links table by repeated star contraction (union-find as joins).

Each round points every node at the smallest node among its neighbours and rewrites the links: first links to
larger neighbours (large star), then to smaller ones (small star). The rounds end when every link points at
the smallest node of its component. Minimums are aggregated map-side; a hub's links are rewritten by a join
that adaptive execution splits. Each round's links are written to the shared folder, so lost executors cost
one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharfline.llm.workdir import Scratch, materialize


def _large_star(scratch: Scratch, links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # minimums as a table of their own, so that the join can be split at a hub
    least = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a > b")


def _small_star(scratch: Scratch, links: DataFrame) -> DataFrame:
    # links run from the larger node a to the smaller node b
    least = scratch.table(links.groupBy("a").agg(F.min("b").alias("m")))
    moved = links.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, most_rounds: int = 60, into: Scratch | None = None) -> DataFrame:
    """node, component (its smallest node) for every node of ``links`` (two columns of one comparable type).

    Links to oneself, repeated and reversed links are allowed; nodes without a link to another one are left out.
    into: where the result is written, if it isn't to be kept.
    """
    spark = links.sparkSession
    a, b = links.columns
    with Scratch(spark, "components") as scratch:
        now = scratch.table(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct())
        for _ in range(most_rounds):
            nxt = scratch.table(_small_star(scratch, scratch.table(_large_star(scratch, now))))
            # a star forest: no node has two links, no centre is itself a leaf
            state = nxt.agg(F.count("*").alias("n"), F.countDistinct("a").alias("leaves")).first()
            if state.n == state.leaves and not nxt.join(nxt.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count():
                found = nxt.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(nxt.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
                return into.table(found) if into else materialize(spark, found, "components")
            now = nxt
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
