"""Bounded breadth-first crawl over a table of pages and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls


def crawl(seeds: DataFrame, links: DataFrame, pages: DataFrame, max_depth: int = 1, max_pages: int = 10) -> DataFrame:
    """(seed, url, depth, ord): pages reached from each seed, in breadth-first order, at most max_pages per seed.

    seeds is (seed), links is (url, href, link_ord), pages is (url).  Links stay on their page's host; URLs are visited once per seed;
    URLs without a page count for nothing.  One join per level: max_depth is a small number of the caller's."""
    known = pages.select(F.col("url").alias("_page")).distinct()
    level = seeds.select("seed", F.col("seed").alias("url"), F.lit(0).alias("depth"), F.array(F.lit(0).cast("bigint")).alias("way"))
    level = level.join(known, F.col("url") == F.col("_page")).drop("_page")
    visited = level
    edges = links.withColumn("to", urls.resolve(F.col("url"), F.col("href"))).where("to is not null").select(F.col("url").alias("_from"), "to", "link_ord")
    for depth in range(1, max_depth + 1):
        reached = level.join(edges, F.col("url") == F.col("_from")).select("seed", F.col("to").alias("url"), F.concat("way", F.array(F.col("link_ord").cast("bigint"))).alias("way"))
        first = reached.groupBy("seed", "url").agg(F.min("way").alias("way")).withColumn("depth", F.lit(depth))
        fresh = first.join(visited.select("seed", "url"), ["seed", "url"], "left_anti").join(known, F.col("url") == F.col("_page")).drop("_page")
        level = fresh.select("seed", "url", "depth", "way")
        visited = visited.unionByName(level)
    order = Window.partitionBy("seed").orderBy("depth", "way")
    return visited.withColumn("ord", F.row_number().over(order).cast("bigint")).where(F.col("ord") <= max_pages).select("seed", "url", "depth", "ord")


def host_waves(pages: DataFrame, cap: int = 3, part_bits: int = 16) -> DataFrame:
    """pages with the wave in which a cap of simultaneous requests per host lets them go.

    Pages are numbered within a host's stretches of 2^part_bits ids, and the stretches' sizes are summed up, so that a host with a third of
    all pages is numbered by many tasks.  Null ids form a stretch of their own, the first."""
    rows = pages.withColumn("host", urls.host(F.col("url"))).withColumn("_part", F.coalesce(F.shiftright("page_id", part_bits), F.lit(-(1 << 62))))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("host", "_part").orderBy("page_id")))
    sizes = rows.groupBy("host", "_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("host").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("host").alias("_host"), F.col("_part").alias("_own"), before.alias("_before"))
    rows = rows.join(sizes, (F.col("host") == F.col("_host")) & (F.col("_part") == F.col("_own")))
    return rows.withColumn("wave", F.ceil((F.col("_n") + F.col("_before")) / cap).cast("bigint")).drop("_part", "_n", "_host", "_own", "_before")
