"""Connected components of an edge table, by alternating large-star and small-star steps.

Links and labels stay distributed; each step's edges are at most as many as before, and are kept in the
shared folder. What a round leaves on disk goes before the next. The driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release
from .common import cut


def _round(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step over distinct edges (a, b), a > b.

    A node's least neighbour is below it, or else it is itself the least; so the large step needs no edge in
    both directions: a goes to the least below b, or to b. In the small step b goes to the least below a.
    """
    below = edges.groupBy("a").agg(F.min("b").alias("m"))
    large = edges.join(below.withColumnRenamed("a", "b").hint("merge"), "b", "left").select("a", F.coalesce("m", "b").alias("b"))
    large = large.repartition("a").distinct()
    below = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(below.hint("merge"), "a")
    both = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))
    return moved.select(F.explode(both).alias("e")).select("e.a", "e.b").where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (a, root): for each node of the edges (a, b), the least node it can reach. Empty edges give no rows."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        new_mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if new_mark == mark or not new_mark["n"]:
            break
        mark = new_mark
        now = cut(_round(now))
        release(edges.sparkSession)
    return now.select("a", F.col("b").alias("root")).union(now.select("b", "b").distinct())
