"""Connected components of a graph of edges, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagefacts.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of ``edges`` (a, b): root is the smallest vertex of its component.

    First the neighbours of each ``a`` are tied to the smallest of them instead of to ``a``, which
    keeps what is connected and leaves about one edge a vertex where many name the same few.
    Each round gives every vertex the smallest root among its own and its neighbours', and then
    follows the root's own root, so chains shorten by doubling. Minima are combined before they
    are shuffled; each round is written to the shared folder. Ends when nothing changes.
    """
    least = F.least("a", F.min("b").over(Window.partitionBy("a"))).alias("m")
    tied = edges.filter("a <> b").select("a", "b", least)
    few = cut_lineage(
        tied.select("b", "m").union(tied.select("a", "m")).toDF("a", "b").filter("a <> b").distinct(), "edges"
    )
    both = few.union(few.select("b", "a"))
    roots = cut_lineage(both.groupBy(F.col("a").alias("v")).agg(F.least("v", F.min("b")).alias("root")), "roots")
    while True:
        offered = both.join(roots, F.col("b") == F.col("v")).select(F.col("a").alias("v"), "root")
        hooked = offered.union(roots.select("v", "root")).groupBy("v").agg(F.min("root").alias("root"))
        hooked = cut_lineage(hooked, "roots")
        over = roots.select(F.col("v").alias("w"), F.col("root").alias("over"))
        jumped = (
            hooked.join(hooked.select(F.col("v").alias("w"), F.col("root").alias("over")), F.col("root") == F.col("w"), "left")
            .select("v", F.least("root", F.coalesce("over", "root")).alias("root"))
        )
        new = cut_lineage(jumped, "roots")
        changed = new.join(over, F.col("v") == F.col("w")).filter(F.col("root") != F.col("over")).limit(1).count()
        roots = new
        if not changed:
            return roots
