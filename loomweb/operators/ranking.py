"""Rank fusion and the six transparent scorers, over long frames (query_id, engine, engine_ord, rank, url, title, snippet).

rank counts from 0.  Every shuffle is on (query_id, key) or (query_id, host)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions import values as V


def fuse(results: DataFrame, k: float = V.RRF_K) -> DataFrame:
    """Reciprocal rank fusion: one row per query and URL key; the first engine's row is the payload."""
    k = k if k > 0 else V.RRF_K
    first = F.struct("engine_ord", "rank", "url", "title", "snippet")
    grouped = results.withColumn("key", urls.fusion_key(F.col("url"))).groupBy("query_id", "key")
    rows = grouped.agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank") + 1)), 9).alias("rrf"), F.min(first).alias("one"))
    rows = rows.select("query_id", "key", "rrf", "one.url", "one.title", "one.snippet")
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "url")
    return rows.withColumn("fused_rank", F.row_number().over(order).cast("bigint"))


def round_robin(results: DataFrame) -> DataFrame:
    """Engines dealt in turn, each URL key at its first place."""
    seen = Window.partitionBy("query_id", "key").orderBy("rank", "engine_ord")
    rows = results.withColumn("key", urls.eval_key(F.col("url"))).withColumn("_n", F.row_number().over(seen)).where("_n = 1")
    order = Window.partitionBy("query_id").orderBy("rank", "engine_ord")
    return rows.select("query_id", "key", "url", F.row_number().over(order).cast("bigint").alias("position"))


def _any_host(host: Column, domains: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [urls.host_matches(host, d) for d in domains], F.lit(False))


def domain_trust(host: Column, high=V.HIGH_TRUST, medium=V.MEDIUM_TRUST, low: list[str] = []) -> Column:  # noqa: B006
    return F.when(_any_host(host, list(high)), 2.0).when(_any_host(host, list(medium)), 0.5).when(_any_host(host, list(low)), -0.5).otherwise(0.0)


def blocklist(host: Column, blocked=V.BLOCKED) -> Column:
    return F.when(_any_host(host, list(blocked)), -5.0).otherwise(0.0)


def url_pattern(url: Column) -> Column:
    low = F.lower(url)
    host = urls.host(low)
    has = lambda parts: reduce(lambda a, b: a | b, [low.contains(p) for p in parts])
    return (
        F.when(_any_host(host, V.DOCS_HOSTS), 1.5)
        .when(host.endswith(".github.io"), 1.0)
        .when(_any_host(host, V.FARM_HOSTS), -1.0)
        .when(has(V.DOCS_PATHS), 0.8)
        .when(has(V.FARM_PATHS), -0.5)
        .otherwise(0.0)
    )


def project_tokens(query: Column) -> Column:
    """Tokens that may name a project; only adjacent repeats go."""
    tokens = F.filter(F.split(F.lower(query), r"\s+"), lambda t: t.contains("-") | t.contains("_") | (t.rlike("^[a-z]{4,}$") & ~t.isin(V.COMMON_WORDS)))
    return F.filter(tokens, lambda t, i: (i == 0) | (t != F.get(tokens, i - 1)))


def project_match(query: Column, title: Column, host: Column) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    return F.when(F.exists(project_tokens(query), lambda t: low.contains(t) | host.contains(t)), 1.5).otherwise(0.0)


def snippet_relevance(query: Column, snippet: Column) -> Column:
    terms = F.filter(F.split(F.lower(query), r"\s+"), lambda t: F.octet_length(t) >= 3)
    low = F.lower(F.coalesce(snippet, F.lit("")))
    share = F.size(F.filter(terms, lambda t: low.contains(t))) / F.size(terms)
    return F.when((F.size(terms) > 0) & snippet.isNotNull(), share).otherwise(0.0)


def score(fused: DataFrame, queries: DataFrame, weights: dict[str, float] = V.WEIGHTS, **lists) -> DataFrame:
    """Fused rows with the scorers' weighted deltas, their sum and the final rank; fused order breaks ties.

    queries is (query_id, query).  lists may replace high, medium, low and blocked."""
    rows = fused.join(queries, "query_id").withColumn("host", urls.host(F.col("url")))
    before = Window.partitionBy("query_id", "host").orderBy("fused_rank")
    deltas = {
        "domain_trust": domain_trust(F.col("host"), **{k: v for k, v in lists.items() if k != "blocked"}),
        "url_pattern": url_pattern(F.col("url")),
        "project_match": project_match(F.col("query"), F.col("title"), F.col("host")),
        "blocklist_penalty": blocklist(F.col("host"), lists.get("blocked", V.BLOCKED)),
        "snippet_relevance": snippet_relevance(F.col("query"), F.col("snippet")),
        "domain_diversity": -0.5 * (F.row_number().over(before) - 1),
    }
    for name, delta in deltas.items():
        rows = rows.withColumn(name, F.round(delta * F.lit(float(weights[name])), 9))
    rows = rows.withColumn("score", F.round(reduce(lambda a, b: a + b, [F.col(n) for n in deltas]), 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "fused_rank")
    return rows.withColumn("final_rank", F.row_number().over(order).cast("bigint"))


def contributions(scored: DataFrame) -> DataFrame:
    """The audit trail: one array of (scorer, delta) per row."""
    names = ["domain_trust", "url_pattern", "project_match", "blocklist_penalty", "snippet_relevance", "domain_diversity"]
    return scored.withColumn("contributions", F.array(*[F.struct(F.lit(n).alias("scorer"), F.col(n).alias("delta")) for n in names]))


def site_scoped(ranked: DataFrame, site: str) -> DataFrame:
    """Rows on the site; a query without any keeps all its rows."""
    rows = ranked.withColumn("_on", urls.site_matches(urls.host(F.col("url")), site))
    n = F.count(F.when(F.col("_on"), 1)).over(Window.partitionBy("query_id"))
    return rows.withColumn("_n", n).where("_on or _n = 0").drop("_on", "_n")
