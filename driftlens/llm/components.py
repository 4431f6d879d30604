"""Connected components of a table of links, with no hub's neighbours in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import join_to_one, written


def _are_stars(edges: DataFrame) -> bool:
    """Whether every id has one link to a smaller one, or only links from larger ones."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up")).union(edges.select(F.col("b").alias("v"), F.lit(0).alias("up")))
    ups, downs = F.sum("up"), F.count_if(F.col("up") == 0)
    return ends.groupBy("v").agg(ups.alias("ups"), downs.alias("downs")).where("ups > 1 OR ups > 0 AND downs > 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links(a, b); the component is its smallest id.

    Large-star and small-star steps alternate until the links are stars around
    smallest ids. A step takes minima by aggregation and joins them back, those
    of hubs by broadcast (join_to_one), so a hub's neighbours are never gathered.
    Every step's links are written to the shared folder, so that a lost executor
    costs one step at most.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    while not _are_stars(edges):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        up = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        large = written(join_to_one(up, least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = join_to_one(large, least, "a")
        small = joined.select("a", F.col("m").alias("b")).union(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        edges = written(small, "links")
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
