"""Connected components of a link table, by alternating star contractions.

Every round replaces the links by links to smaller neighbours (large star, then small star) until
they are stars; each round is written to the shared checkpoint folder. Minima are aggregated before
they are shuffled and stream through sort-merge joins back to the links. These stay merge joins at every
size: as a broadcast, each would be built in the driver, several a round, for a few rows.
No component is ever held in memory by one task or by the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stage


def _minimum(pairs: DataFrame, own: bool) -> DataFrame:
    """Per ``u`` the smallest of its ``v`` (and of itself)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return (least.withColumn("m", F.least("u", "m")) if own else least).hint("merge")


def _large_star(links: DataFrame) -> DataFrame:
    there, back = F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
    both = links.select(F.inline(F.array(there, back)))  # read once: each scan and stage is a broadcast of the driver's
    joined = both.join(_minimum(both, True), "u").filter("v > u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_minimum(down, False), "u")
    moved, stay = (F.struct(F.col(c).alias("u"), F.col("m").alias("v")) for c in "vu")
    return joined.select(F.inline(F.array(moved, stay))).filter("u <> v")


def _are_stars(links: DataFrame) -> bool:
    """Whether every node of the different ``links`` (u > v) is either a root or has one link, to a root: nothing is left to
    contract, and each root is the smallest of its component."""
    leaf, root = (F.struct(F.col(c).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down")) for c, up in (("u", 1), ("v", 0)))
    sums = links.select(F.inline(F.array(leaf, root))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).count() == 0


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v: comparable, not null): root is the
    smallest node reachable. Loops and repeated links are allowed; no links give no rows."""
    current = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = stage(current.distinct(), "links")
    while not _are_stars(current):
        current = stage(_small_star(_large_star(current)).distinct(), "links")
    leaf, root = (F.struct(F.col(c).alias("node"), F.col("v").alias("root")) for c in "uv")
    return current.select(F.inline(F.array(leaf, root))).distinct()
