"""Offline evaluation of ranked lists (query_id, rank from 1, url) against gold URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls


def first_match(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, hit): the first rank whose URL has the evaluation key of a gold URL; null if none.

    gold is (query_id, gold_url)."""
    keyed = ranked.select("query_id", "rank", urls.eval_key(F.col("url")).alias("key"))
    wanted = gold.select("query_id", urls.eval_key(F.col("gold_url")).alias("key"))
    hits = keyed.join(wanted, ["query_id", "key"]).groupBy("query_id").agg(F.min("rank").alias("hit"))
    return gold.select("query_id").distinct().join(hits, "query_id", "left")


def recall(hits: DataFrame, k: int = 10) -> DataFrame:
    """One row: questions, recall at 1, 5, 10 and k, coverage and mean reciprocal rank."""
    share = lambda c: F.round(F.coalesce(F.try_divide(F.count_if(c), F.count("*")), F.lit(0.0)), 9)
    at = lambda n: share(F.col("hit") <= n)
    return hits.agg(
        F.count("*").alias("questions"),
        at(1).alias("recall_1"),
        at(5).alias("recall_5"),
        at(10).alias("recall_10"),
        at(k).alias("recall_k"),
        share(F.col("hit").isNotNull()).alias("coverage"),
        F.round(F.avg(F.coalesce(1.0 / F.col("hit"), F.lit(0.0))), 9).alias("mrr"),
    )


def recall_report(hits: DataFrame, k: int = 10) -> DataFrame:
    """One row of counts and shares over all questions of hits(query_id, hit, n_results, exit_code).

    Questions that were blocked (3) or without content (4) are counted as such and as nothing else; the others pass within k, miss beyond it, or
    fail.  mrr is over all questions, objective over those that were evaluated."""
    code = F.coalesce("exit_code", F.lit(0))
    rows = hits.withColumn("_in", ~code.isin(3, 4)).withColumn("_hit", F.when(~code.isin(3, 4) & (F.col("n_results") > 0), F.col("hit")))
    share = lambda c: F.round(F.coalesce(F.try_divide(F.count_if(c), F.count("*")), F.lit(0.0)), 9)
    mean = lambda n: F.round(F.coalesce(F.try_divide(F.sum(F.coalesce(1.0 / F.col("_hit"), F.lit(0.0))), n), F.lit(0.0)), 9)
    there = F.col("_hit").isNotNull()
    return rows.agg(
        F.count("*").alias("questions"), F.count_if(code == 3).alias("blocked"), F.count_if(code == 4).alias("no_content"),
        F.count_if(F.col("_hit") <= k).alias("passed"), F.count_if(F.col("_hit") > k).alias("missed"), F.count_if(F.col("_in") & ~there).alias("failed"),
        share(F.col("_hit") <= k).alias("recall_k"), share(F.col("_hit") == 1).alias("recall_1"), share(there).alias("coverage"),
        mean(F.count("*")).alias("mrr"), mean(F.count_if(F.col("_in"))).alias("objective"),
    )


def url_recall(hits: DataFrame, k: int = 10) -> DataFrame:
    """One row: the share of questions whose URL is among the first 1, 5, 10, k or any results of hits(query_id, hit, n_results), the gap, and how many have no results."""
    share = lambda c: F.round(F.coalesce(F.try_divide(F.count_if(c), F.count("*")), F.lit(0.0)), 9)
    there = F.coalesce(F.col("hit").isNotNull() & (F.col("n_results") > 0), F.lit(False))
    cuts = [share(there & (F.col("hit") <= n)).alias(f"recall_{name}") for n, name in ((1, "1"), (5, "5"), (10, "10"), (k, "k"))]
    return hits.agg(F.count("*").alias("questions"), *cuts, share(there).alias("recall_any"), share(~there).alias("gap"), F.count_if(F.col("n_results") == 0).alias("empty"))


def relevance(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """ranked with rel: 2 for a preferred gold URL, 1 for another, else 0; a gold URL also matches what lies below it.

    gold is (query_id, gold_url, preferred).  The join has query_id as its equal part."""
    g = gold.withColumnRenamed("query_id", "_q")
    joined = ranked.join(g, (F.col("query_id") == F.col("_q")) & urls.gold_matches(F.col("url"), F.col("gold_url")), "left")
    rel = F.max(F.when(F.col("preferred"), 2).when(F.col("gold_url").isNotNull(), 1).otherwise(0)).cast("bigint")
    return joined.groupBy("query_id", "rank", "url").agg(rel.alias("rel"))


def _gain(rel: Column, rank: Column) -> Column:
    return rel / F.log2(rank + 1.0)


def ndcg(ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, success_1, success_3, success_5, rr, ndcg).  ndcg passes 1 where several results match one gold URL."""
    rel = relevance(ranked, gold)
    got = rel.groupBy("query_id").agg(
        *[F.max((F.col("rel") > 0) & (F.col("rank") <= n)).alias(f"success_{n}") for n in (1, 3, 5)],
        F.coalesce(1.0 / F.min(F.when(F.col("rel") > 0, F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.sum(F.when(F.col("rank") <= k, _gain(F.col("rel"), F.col("rank"))).otherwise(0.0)).alias("dcg"),
    )
    best = gold.groupBy("query_id").agg(F.reverse(F.sort_array(F.collect_list(F.when(F.col("preferred"), 2).otherwise(1)))).alias("rels"))
    terms = F.transform(F.slice("rels", 1, k), lambda r, i: r / F.log2(i + 2.0))
    ideal = best.select("query_id", F.aggregate(terms, F.lit(0.0), lambda s, x: s + x).alias("ideal"))
    rows = got.join(ideal, "query_id")
    return rows.select("query_id", "success_1", "success_3", "success_5", F.round("rr", 9).alias("rr"), F.round(F.coalesce(F.try_divide("dcg", "ideal"), F.lit(0.0)), 9).alias("ndcg"))


def tuning_objective(lists: DataFrame, queries: DataFrame, gold: DataFrame, codes: DataFrame | None = None):
    """weights -> mean reciprocal rank of the gold URLs over the questions that are evaluated, for coordinate_ascent().

    lists are engines' ranked lists, gold is (query_id, gold_url), codes is (query_id, exit_code).  Each call is one job; what does
    not depend on the weights is in the lists."""
    from . import ranking

    def objective(weights: dict[str, float]) -> float:
        own = {k: v for k, v in weights.items() if k != "rrf_k"}
        ranked = ranking.score(ranking.fuse(lists, weights.get("rrf_k", 60.0)), queries, own).select("query_id", F.col("final_rank").alias("rank"), "url")
        hits = first_match(ranked, gold).withColumn("n_results", F.lit(1))
        hits = hits.join(codes, "query_id", "left") if codes is not None else hits.withColumn("exit_code", F.lit(0))
        return float(recall_report(hits).first()["objective"])

    return objective


def coordinate_ascent(objective, weights: dict[str, float], step: float = 0.1, passes: int = 5) -> dict[str, float]:
    """Greedy tuning: each weight in turn moves up or down by step if that betters objective(weights); up is tried first."""
    best, value = dict(weights), objective(weights)
    for _ in range(passes):
        before = value
        for name in weights:
            for way in (step, -step):
                tried = best | {name: max(best[name] + way, 1.0 if name == "rrf_k" else 0.0)}
                found = objective(tried)
                if found > value:
                    best, value = tried, found
                    break
        if value <= before:
            break
    return best
