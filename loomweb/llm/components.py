"""Connected components of a distributed edge list, by alternating stars.

Each round is two joins and two aggregations whose partial sums run before
the shuffle, so a hub with a third of all edges stays spread over tasks.  The
edge list is written to the shared folder after every round, and the one before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import release, written


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def component_labels(edges: DataFrame) -> DataFrame:
    """(id, label) for every id on an edge; label is its component's smallest id.

    ``edges`` has bigint columns ``u`` and ``v``.  Self loops are dropped, repeated
    edges count once and an empty list gives an empty result.
    """
    edges = edges.where("u is not null and v is not null and u <> v")
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while (now := _signature(edges)) != before:
        before = now
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "lowest")
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "edges")
        release(edges, lowest)
        # small star: u and its smaller neighbours go to the smallest of them
        lowest = written(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        joined = large.join(lowest, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "edges")
        release(large, lowest)
    ends = edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "id")
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("label", F.col("id"))
    return ends.unionByName(roots)
