"""Queries on ranked lists: fusion, scorers, result pages, failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import cascade, formats, ranking
from .base import AUTH, EVAL_KEY, FUSION_KEY, N_QUERIES, TITLE, _any_host, _page, _sql_list, _worded, _worded_sql, query, read
LOW_TRUST = ["example.net"]
#: Some of the pages under hosts that the scorers know, as SQL for either engine.
KNOWN = """case page_id % 19 when 0 then concat('https://docs.rs/c', page_id, '/latest/') when 1 then concat('https://u', page_id, '.github.io/docs/') when 2 then concat('https://medium.com/what-is-', page_id) when 3 then concat('https://www.w3schools.com/p', page_id)
 when 4 then concat('https://stackoverflow.com/questions/', page_id) when 5 then concat('https://geeksforgeeks.org/introduction-to-', page_id) when 6 then concat('https://x.example.net/what-is-', page_id) when 7 then concat('https://pypi.org/reference/', page_id) else url end"""
ENGINES = f"""with base as (select page_id % {N_QUERIES} as query_id, page_id, {KNOWN} as url, {TITLE} as title, substr(regexp_replace(html, '<[^>]*>', ' ', 'g'), 1, 200) as snippet, length(html) as n from pages),
e as (select query_id, 'e1' as engine, 0 as engine_ord, row_number() over (partition by query_id order by page_id) - 1 as rank, url, title, snippet from base
 union all select query_id, 'e2', 1, row_number() over (partition by query_id order by n, page_id) - 1, url, title, snippet from base
 union all select query_id, 'e3', 2, row_number() over (partition by query_id order by page_id desc) - 1, url, title, snippet from base),
k as (select *, {FUSION_KEY} as key, {EVAL_KEY} as ekey, {AUTH} as host from e),
f0 as (select query_id, key, round(sum(1.0::double / (60.0 + rank + 1)), 9) as rrf, arg_min(struct_pack(url := url, title := title, snippet := snippet), engine_ord * 1000000000 + rank) as one from k group by 1, 2),
f as (select query_id, key, rrf, one.url as url, one.title as title, one.snippet as snippet, row_number() over (partition by query_id order by rrf desc, one.url) as fused_rank from f0),
q as (select item_id as query_id, array_to_string(list_slice(regexp_split_to_array(text, '\\s+'), 1, 4), ' ') as query from benchmark),
j as (select f.*, q.query, {AUTH.replace("url", "f.url")} as host, list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda t: strlen(t) >= 3) as terms,
 list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda t: contains(t, '-') or contains(t, '_') or (regexp_full_match(t, '[a-z]{{4,}}') and t not in ({_sql_list(V.COMMON_WORDS)}))) as tokens from f join q using (query_id)),
s as (select *, round(1.0 * case when {_any_host("host", V.HIGH_TRUST)} then 2.0 when {_any_host("host", V.MEDIUM_TRUST)} then 0.5 when {_any_host("host", LOW_TRUST)} then -0.5 else 0 end, 9) as domain_trust,
 round(0.8 * case when {_any_host("host", V.DOCS_HOSTS)} then 1.5 when host like '%.github.io' then 1.0 when {_any_host("host", V.FARM_HOSTS)} then -1.0 when {" or ".join(f"contains(lower(url), '{p}')" for p in V.DOCS_PATHS)} then 0.8 when {" or ".join(f"contains(lower(url), '{p}')" for p in V.FARM_PATHS)} then -0.5 else 0 end, 9) as url_pattern,
 round(1.2 * case when len(list_filter(tokens, lambda t: contains(lower(title), t) or contains(host, t))) > 0 then 1.5 else 0 end, 9) as project_match,
 round(case when {_any_host("host", V.BLOCKED)} then -5.0 else 0 end, 9) as blocklist_penalty,
 round(0.6 * case when len(terms) > 0 then len(list_filter(terms, lambda t: contains(lower(snippet), t)))::double / len(terms) else 0 end, 9) as snippet_relevance,
 round(0.5 * -0.5 * (row_number() over (partition by query_id, host order by fused_rank) - 1), 9) as domain_diversity from j),
t as (select *, round(domain_trust + url_pattern + project_match + blocklist_penalty + snippet_relevance + domain_diversity, 9) as score from s),
r as (select *, row_number() over (partition by query_id order by score desc, fused_rank) as final_rank from t)
"""


def engines(spark, sf_dir) -> DataFrame:
    """Three ranked lists of all pages, dealt to N_QUERIES queries."""
    from pyspark.sql import Window

    base = read(spark, sf_dir, "pages").select(
        F.pmod("page_id", F.lit(N_QUERIES)).alias("query_id"), "page_id", F.expr(KNOWN).alias("url"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.substring(F.regexp_replace("html", "<[^>]*>", " "), 1, 200).alias("snippet"), F.length("html").alias("n"),
    )
    out = None
    for ord_, (name, order) in enumerate((("e1", ["page_id"]), ("e2", ["n", "page_id"]), ("e3", [F.desc("page_id")]))):
        rank = (F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1).cast("bigint")
        one = base.select("query_id", F.lit(name).alias("engine"), F.lit(ord_).alias("engine_ord"), rank.alias("rank"), "url", "title", "snippet")
        out = one if out is None else out.unionByName(one)
    return out


def query_texts(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", r"\s+"), 1, 4), " ").alias("query"))


def ranked(spark, sf_dir) -> DataFrame:
    return ranking.score(ranking.fuse(engines(spark, sf_dir)), query_texts(spark, sf_dir), low=LOW_TRUST)


@query(ENGINES + "select query_id, key, rrf, fused_rank from f")
def fuse_rrf(spark, sf_dir):
    return ranking.fuse(engines(spark, sf_dir)).select("query_id", "key", "rrf", "fused_rank")


@query(ENGINES + "select query_id, key, url, title from f")
def fuse_first_payload(spark, sf_dir):
    return ranking.fuse(engines(spark, sf_dir)).select("query_id", "key", "url", "title")


@query(ENGINES + "select query_id, ekey as key, row_number() over (partition by query_id order by rank, engine_ord) as position from (select *, row_number() over (partition by query_id, ekey order by rank, engine_ord) as n from k) where n = 1")
def fuse_round_robin(spark, sf_dir):
    return ranking.round_robin(engines(spark, sf_dir)).select("query_id", "key", "position")


def _scorer(name: str):
    def run(spark, sf_dir):
        return ranked(spark, sf_dir).select("query_id", "url", F.col(name).cast("double").alias(name))

    run.__name__ = f"score_{name}"
    query(ENGINES + f"select query_id, url, {name}::double as {name} from s")(run)


for _name in ("domain_trust", "url_pattern", "project_match", "blocklist_penalty", "snippet_relevance", "domain_diversity"):
    _scorer(_name)


@query(_worded_sql(5, "benchmark", "item_id") + f"""select item_id, array_to_string(list_filter(ts, lambda t, i: i = 1 or ts[i - 1] <> t), ' ') as tokens from (select item_id, list_filter([lower(w0), lower(w0), lower(w1) || '-x', 'rust', lower(w2), 'ab_c', 'ab_c', lower(w3), lower(w3), 'abc', 'Ünd', lower(w0)], lambda t: contains(t, '-') or contains(t, '_') or (regexp_full_match(t, '[a-z]{{4,}}') and t not in ({_sql_list(V.COMMON_WORDS)}))) as ts from t)""")
def score_project_tokens(spark, sf_dir):
    text = _page("{w0} {w0} {w1}-x Rust {w2} ab_c  ab_c {w3} {w3} abc Ünd {w0}")
    return _worded(spark, sf_dir, 5, "benchmark", "item_id").select("item_id", F.array_join(ranking.project_tokens(text), " ").alias("tokens"))


@query(ENGINES + "select query_id, url, score::double as score, final_rank from r")
def search_ranked(spark, sf_dir):
    return ranked(spark, sf_dir).select("query_id", "url", "score", "final_rank")


@query(ENGINES + "select query_id, url, final_rank from (select *, (host = 'example.net' or host like '%.example.net') as hit, count(*) filter (host = 'example.net' or host like '%.example.net') over (partition by query_id) as n from r) where hit or n = 0")
def search_site_scoped(spark, sf_dir):
    return ranking.site_scoped(ranked(spark, sf_dir), "example.net").select("query_id", "url", "final_rank")


LINK = "'[' || title || '](' || url || ')'"
FLAT = "replace(snippet, chr(10), ' ')"
SERP = {
    "compact": (1, f"'- ' || {LINK} || chr(10)"),
    "standard": (2, f"'- ' || {LINK} || chr(10) || coalesce('  > ' || {FLAT} || chr(10), '')"),
    "full": (3, f"'### ' || {LINK} || chr(10) || coalesce(snippet || chr(10), '') || '---' || chr(10)"),
}
BLOCKS = {
    "compact": (1, f"'- ' || {LINK}"),
    "standard": (2, f"'- ' || {LINK} || coalesce(chr(10) || chr(10) || {FLAT}, '')"),
    "full": (3, f"'### ' || {LINK} || coalesce(chr(10) || chr(10) || snippet, '')"),
}


for _name, (_density, _line) in SERP.items():

    def _serp(spark, sf_dir, density=_density):
        return formats.result_page(ranked(spark, sf_dir), density)

    _serp.__name__ = f"search_serp_{_name}"
    query(ENGINES + f"select query_id, regexp_replace(string_agg({_line}, '' order by final_rank), '^\\s+|\\s+$', '', 'g') as page from r group by 1")(_serp)


for _name, (_density, _line) in BLOCKS.items():

    def _structured(spark, sf_dir, density=_density):
        return formats.result_page(ranked(spark, sf_dir), density, "structured")

    _structured.__name__ = f"search_structured_{_name}"
    _body = f"'---' || chr(10) || 'source: ' || url || chr(10) || 'title: ' || replace(title, chr(10), ' ') || chr(10) || 'type: search_result' || chr(10) || 'fetched: unknown' || chr(10) || '---' || chr(10) || chr(10) || regexp_replace({_line}, '^\\s+|\\s+$', '', 'g')"
    query(ENGINES + f"select query_id, string_agg({_body}, chr(10) || chr(10) order by final_rank) as page from r group by 1")(_structured)


#: Engines fail for some queries; a query of number 3 mod 5 has none left.
FAILS = "case when query_id % 5 = 3 then true when query_id % 5 = 1 then engine = 'e2' else false end"


@query(ENGINES + f"""select query_id, engine, rank, url from e where not ({FAILS}) and not (query_id % 5 in (1, 3) and query_id % 5 = 3)""")
def search_degraded(spark, sf_dir):
    lists = engines(spark, sf_dir)
    failed = lists.select("query_id", "engine").distinct().where(F.expr(FAILS))
    return cascade.fan_out(lists, ["e1"], failed).select("query_id", "engine", "rank", "url")


@query(ENGINES + """select query_id, case when trim(query) = '' then 'query is empty' when query_id % 5 = 3 then 'all search engines failed or returned no results (e1: timeout; e2: timeout; e3: timeout; e4: no results)' end as error from (select query_id, case when query_id % 7 = 6 then '  ' else query end as query from q where query_id in (select query_id from e))""")
def search_errors(spark, sf_dir):
    lists = engines(spark, sf_dir)
    asked = query_texts(spark, sf_dir).join(lists.select("query_id").distinct(), "query_id").withColumn("query", F.when(F.col("query_id") % 7 == 6, "  ").otherwise(F.col("query")))
    failed = lists.select("query_id", "engine").distinct().where(F.expr(FAILS))
    left = lists.join(failed, ["query_id", "engine"], "left_anti")
    return cascade.search_errors(asked, left, ["e1", "e2", "e3", "e4"], failed.withColumn("error", F.lit("timeout")))
