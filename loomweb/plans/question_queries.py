"""Questions, benchmarks and cached results in files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import adapters, evals
from .base import query, read, scratch
from .ranked_queries import ENGINES, engines, query_texts


def _asked_line() -> Column:
    """A question under one of the names that its fields may have, as JSON."""
    kind = F.col("item_id") % 3
    plain = F.to_json(F.struct(F.concat(F.lit(" "), F.col("q")).alias("question"), F.col("u").alias("source_url"), F.col("a").alias("answer")))
    other = F.to_json(F.struct(F.lit("  ").alias("question"), F.col("q").alias("query"), F.col("u").alias("url"), F.col("a").alias("reference_answer")))
    return F.when(kind == 0, plain).when(kind == 1, other).otherwise(F.to_json(F.struct(F.col("q").alias("prompt"), F.col("u").alias("sourceUrl"), F.lit(1).alias("extra"))))


QUESTIONS = "select item_id, trim(substr(text, 1, 60)) as question, 'https://e.com/' || item_id as source_url, case when item_id % 3 = 2 then '' else 'answer ' || item_id end as answer from benchmark"


def _questions(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.trim(F.substring("text", 1, 60)).alias("q"), F.concat(F.lit("https://e.com/"), F.col("item_id").cast("string")).alias("u"), F.concat(F.lit("answer "), F.col("item_id").cast("string")).alias("a"))
    return rows.select("item_id", _asked_line().alias("line"))


@query(f"select question, source_url, answer from ({QUESTIONS})")
def ref_alias_resolve(spark, sf_dir):
    return adapters.reference_question(_questions(spark, sf_dir).select(F.from_json("line", adapters.REF).alias("r")).select("r.*"))


@query(f"select question, source_url, answer from ({QUESTIONS})")
def ref_question_files(spark, sf_dir):
    path = f"{scratch(spark)}/questions.jsonl"
    _questions(spark, sf_dir).select("line").write.text(path)
    return evals.load_questions(spark, path)


@query("select item_id, trim(text) as question, 'https://e.com/' || item_id as source_url from benchmark where item_id % 2 = 0 union all select item_id, text, null from benchmark where item_id % 2 = 1")
def ref_split_urls(spark, sf_dir):
    text = F.when(F.col("item_id") % 2 == 0, F.concat("text", F.lit(evals.REFERENCE_MARK + "https://e.com/"), F.col("item_id").cast("string"), F.lit(" "))).otherwise(F.col("text"))
    question, url = evals.split_reference(text)
    return read(spark, sf_dir, "benchmark").select("item_id", question.alias("question"), url.alias("source_url"))


@query(ENGINES + """select substr(query, 1, 40) as query, 'general_technical' as intent, array_to_string(list_sort(list(url) filter (rank < 2)), ' ') as gold_urls, count(*) filter (rank < 3) as n_results, 0::bigint as n_negative from q join e using (query_id) where engine = 'e1' group by query_id, query""")
def bench_files(spark, sf_dir):
    rows = engines(spark, sf_dir).where("engine = 'e1'").join(query_texts(spark, sf_dir), "query_id")
    results = F.sort_array(F.collect_list(F.when(F.col("rank") < 3, F.struct("rank", "url", "title", "snippet"))))
    made = rows.groupBy("query_id", "query").agg(F.sort_array(F.collect_list(F.when(F.col("rank") < 2, F.col("url")))).alias("gold_urls"), F.transform(results, lambda r: F.struct(r["url"].alias("url"), r["title"].alias("title"), r["snippet"].alias("snippet"))).alias("baseline_results"))
    path = f"{scratch(spark)}/bench.jsonl"
    made.select(F.substring("query", 1, 40).alias("query"), F.lit("general_technical").alias("intent"), "gold_urls", F.slice("gold_urls", 1, 1).alias("gold_priority"), "baseline_results").write.json(path)
    found = evals.load_benchmark(spark, path)
    return found.select("query", "intent", F.array_join("gold_urls", " ").alias("gold_urls"), F.size("baseline_results").cast("bigint").alias("n_results"), F.size("negative_urls").cast("bigint").alias("n_negative"))


#: Engines of a question: all fail for 0 of 4, one fails for 1, none has anything for 2.
ROLLED = f"with q as ({QUESTIONS}), n as (select *, item_id % 4 as k from q)\n"


def _rolled(spark, sf_dir) -> DataFrame:
    rows = adapters.reference_question(_questions(spark, sf_dir).select("item_id", F.from_json("line", adapters.REF).alias("r")).select("item_id", "r.*"))
    named = read(spark, sf_dir, "benchmark").select("item_id", F.trim(F.substring("text", 1, 60)).alias("question"))
    engine = F.explode(F.array(*[F.lit(e) for e in evals.ENGINES])).alias("engine")
    k = F.col("item_id") % 4
    failed = (k == 0) | ((k == 1) & (F.col("engine") == "ddg_lite"))
    result = F.array(F.struct(F.concat(F.lit("https://e.com/"), F.col("item_id").cast("string")).alias("url"), F.col("engine").alias("title"), F.lit(None).cast("string").alias("snippet")))
    answered = named.select("item_id", "question", engine).select("question", "engine", failed.alias("failed"), F.when(k.isin(1, 3), result).otherwise(F.array().cast(evals.RECORD)).alias("results"))
    return evals.roll_up(rows, answered, F.lit(1_700_000_000))


@query(ROLLED + "select question, source_url, case k when 0 then 3 when 2 then 4 else 0 end as exit_code, case k when 1 then 2 when 3 then 3 else 0 end as n_results, '1700000000' as cached_at from n")
def cache_roll_up(spark, sf_dir):
    found = F.aggregate(F.map_values("engine_results"), F.lit(0), lambda a, x: a + F.size(x))
    return _rolled(spark, sf_dir).select("question", "source_url", "exit_code", found.alias("n_results"), "cached_at")


@query(ROLLED + "select sha256(question) as query_id, e as engine, 0::bigint as rank, source_url as url, e as title from n, (select unnest(['searxng', 'ddg_lite', 'marginalia']) as e) where k = 3 or (k = 1 and e <> 'ddg_lite')")
def cache_files(spark, sf_dir):
    folder = f"{scratch(spark)}/cache"
    evals.write_cache(_rolled(spark, sf_dir), folder)
    return evals.engine_lists(evals.load_cache(spark, folder)).select("query_id", "engine", "rank", "url", "title")


@query(ROLLED + "select question from n where item_id % 5 <> 1")
def cache_due_questions(spark, sf_dir):
    named = read(spark, sf_dir, "benchmark").select("item_id", F.trim(F.substring("text", 1, 60)).alias("question"))
    stored = named.where("item_id % 5 in (1, 2)").select("question", F.when(F.col("item_id") % 5 == 1, "1700000000").otherwise("1600000000").alias("cached_at"))
    return evals.due_questions(named, stored, F.lit(1_700_000_100), 86400).select("question")
