"""Connected components by DataFrame joins, for graphs far larger than the driver.

`roots` resolves a forest of parent links by pointer doubling; `components` takes any links and alternates the
large-star and small-star steps of Kiveris et al. (2014). Every round is written to the shared folder, so a lost
executor costs at most a round, and only counts reach the driver. Smallest ids are found by map-side combined
minima, and hot nodes meet their links in joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import remove_table, written


def roots(parents: DataFrame) -> DataFrame:
    """(node, parent) with parent < node, one row per node, to (node, root)."""
    now = written(parents.select("node", F.col("parent").alias("root")), "roots")
    while True:
        up = now.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        step = now.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved"))
        step = written(step, "roots")
        remove_table(now)
        if step.where("moved").isEmpty():
            return step.select("node", "root")
        now = step.select("node", "root")
        now.stored_at = step.stored_at


def components(links: DataFrame) -> DataFrame:
    """(a, b), in any order and repeated or not, to (node, root): the smallest node reachable, for all but roots."""
    now = written(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    last = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(seen) == last or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = tuple(seen)
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every neighbour above u links to u's smallest
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = written(large, "links")
        # small star: u and its neighbours below link to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).where("u != v").distinct()
        before, now = now, written(small.toDF("u", "v"), "links")
        remove_table(before)
        remove_table(large)
