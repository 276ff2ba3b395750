"""Connected components of a link table, by alternating large and small stars.

Each round, every node links its larger neighbours, and then its smaller ones, to the least node that it
knows; rounds end when the links stay the same. Links live in the shared folder between rounds. Nothing but
two counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def large_star(links: DataFrame) -> DataFrame:
    """Links (node, least) with least < node."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    met = both.where("b > a").join(least, "a")
    return met.select(F.col("least").alias("a"), "b").where("a < b").distinct()


def small_star(links: DataFrame) -> DataFrame:
    """From links with a < b: each b's smaller neighbours, and itself, link to the least of them."""
    least = links.groupBy("b").agg(F.min("a").alias("least"))
    met = links.join(least, "b")
    ends = met.select(F.col("least").alias("a"), F.col("a").alias("b")).unionAll(least.select(F.col("least").alias("a"), "b"))
    return ends.where("a < b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(fp, label) for each node that has a link: label is the least node of its component. links: (a, b)."""
    now = materialize(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "star")
    mark = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark or not state[0]:
            break
        mark = state
        before, now = now, materialize(small_star(large_star(now)), "star")
        discard(before)
    return now.select(F.col("b").alias("fp"), F.col("a").alias("label")).unionAll(now.select(F.col("a").alias("fp"), F.col("a").alias("label")).distinct())
