"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

LINKS_PER_FILE = 1_000_000


def components(links: DataFrame) -> DataFrame:
    """For links (a, b): (id, root) of every node with a link, root being its component's smallest id. Each step hooks
    every node onto its smallest neighbour below it, halves the paths until they end in roots, and goes on with the
    links between different roots. All tables are stored, so a lost executor repeats one step at most."""
    links = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, roots = materialise(links), None
    # Small tables go in few files, whatever the number of shuffle partitions.
    stored = lambda df: materialise(df.coalesce(files))
    while (n := links.count()) > 0:
        files = 8 + n // LINKS_PER_FILE
        hooks = stored(links.groupBy("a").agg(F.min("b").alias("b")))
        while True:
            further = hooks.select(F.col("a").alias("b"), F.col("b").alias("c"))
            hooks = stored(hooks.join(further, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")))
            if hooks.where("moved").isEmpty():
                break
            hooks = hooks.select("a", "b")
        hooks = hooks.select(F.col("a").alias("id"), F.col("b").alias("root"))
        up = hooks.select(F.col("id").alias("root"), F.col("root").alias("to"))
        if roots is None:
            roots = hooks
        else:
            roots = stored(roots.join(up, "root", "left").select("id", F.coalesce("to", "root").alias("root")).unionByName(hooks))
        for end in ("a", "b"):
            links = links.join(hooks.withColumnRenamed("id", end), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        links = stored(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if roots is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("root"))
    ends = roots.select("root").distinct().join(roots.select(F.col("id").alias("root")), "root", "left_anti")
    return roots.unionByName(ends.select(F.col("root").alias("id"), "root"))
