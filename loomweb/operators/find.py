"""Keyword block filter: blocks with all terms, else the best few with some."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BEST = 5


def parse_terms(text: str) -> list[str]:
    """Comma-separated terms, trimmed, ASCII-lowered, each once."""
    low = [t.strip().translate(str.maketrans(UP, LOW)) for t in text.split(",")]
    return list(dict.fromkeys(t for t in low if t))


def find_blocks(docs: DataFrame, text: Column, terms: list[str]) -> DataFrame:
    """docs with matched_terms, match_mode (all, partial or none) and filtered_text.

    Blocks are split at blank lines and keep their numbers; matching is by ASCII-lowered substring."""
    wanted = F.array(*[F.lit(t) for t in terms])
    low = lambda x: F.translate(x, UP, LOW)
    blocks = F.transform(F.split(text, "\n\n"), lambda b, i: F.struct(i.alias("at"), F.trim(b).alias("block")))
    blocks = F.filter(blocks, lambda b: b["block"] != "")

    def mentions(block: Column) -> Column:
        each = F.transform(wanted, lambda t: ((F.length(low(block)) - F.length(F.replace(low(block), t, F.lit("")))) / F.length(t)).cast("bigint"))
        return F.aggregate(each, F.lit(0).cast("bigint"), lambda s, x: s + x)

    matched = lambda b: F.size(F.filter(wanted, lambda t: F.contains(low(b["block"]), t)))
    ranked = F.transform(blocks, lambda b: F.struct((-matched(b)).alias("m"), (-mentions(b["block"])).alias("n"), b["at"].alias("at"), b["block"].alias("block")))
    rows = docs.withColumn("_ranked", ranked)
    every = F.filter("_ranked", lambda b: -b["m"] == len(terms))
    some = F.slice(F.sort_array(F.filter("_ranked", lambda b: b["m"] < 0)), 1, BEST)
    by_place = lambda xs: F.transform(F.sort_array(F.transform(xs, lambda b: F.struct(b["at"].alias("at"), b["block"].alias("block")))), lambda b: b["block"])
    mode = F.when(F.size(every) > 0, "all").when(F.size(some) > 0, "partial").otherwise("none")
    rows = rows.withColumn("match_mode", mode)
    rows = rows.withColumn("filtered_text", F.array_join(F.when(F.col("match_mode") == "all", by_place(every)).otherwise(by_place(some)), "\n\n"))
    return rows.withColumn("matched_terms", F.filter(wanted, lambda t: F.contains(low(text), t))).drop("_ranked")
