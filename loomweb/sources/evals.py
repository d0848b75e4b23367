"""Files of labelled questions, benchmarks and cached engine results, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import REF, reference_question

# The fields of cached results and of benchmark rows, the engines, and what parts a question from its URLs.
RECORD = "array<struct<url:string,title:string,snippet:string>>"
ENGINES = ("searxng", "ddg_lite", "marginalia")
CACHE = f"question string, source_url string, answer string, engine_results map<string,{RECORD}>, cached_at string, exit_code int"
BENCH = f"query string, intent string, gold_urls array<string>, gold_priority array<string>, negative_urls array<string>, baseline_results {RECORD}, supplemental_results map<string,{RECORD}>"
REFERENCE_MARK = "\n\nReference URLs:\n- "


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """(question, source_url, answer) of a JSONL file; blank lines are skipped, a row without a question or a URL is an error."""
    if not path.lower().rstrip("/").endswith(".jsonl"):
        raise ValueError(f"questions are read from .jsonl, not from {path}; convert_questions() makes one of a table")
    rows = reference_question(spark.read.schema(REF).option("mode", "FAILFAST").json(path))
    need = lambda name: F.coalesce(F.col(name), F.raise_error(F.lit(f"a question row has no {name}")).cast("string")).alias(name)
    return rows.select(need("question"), need("source_url"), "answer")


def load_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark rows of a JSONL file; lists that are left out are empty."""
    rows = spark.read.schema(BENCH).option("mode", "FAILFAST").json(path)
    empty = {"negative_urls": F.array().cast("array<string>"), "supplemental_results": F.create_map().cast(f"map<string,{RECORD}>")}
    return rows.withColumns({name: F.coalesce(F.col(name), value) for name, value in empty.items()})


def load_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Cached questions of a folder, one JSON document or line each, with their file's path; in the order of paths."""
    rows = spark.read.schema(CACHE).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    return rows.select("*", F.col("_metadata.file_path").alias("path")).orderBy("path", "question")


def question_key(question: Column) -> Column:
    return F.sha2(question, 256)


def due_questions(questions: DataFrame, cached: DataFrame, now: Column, max_age_seconds: int) -> DataFrame:
    """questions that have no cached row of at most that age; cached_at counts seconds."""
    fresh = cached.where(now - F.col("cached_at").cast("bigint") <= max_age_seconds).select(question_key(F.col("question")).alias("_key"))
    return questions.join(fresh, question_key(F.col("question")) == F.col("_key"), "left_anti")


def roll_up(questions: DataFrame, answered: DataFrame, now: Column) -> DataFrame:
    """questions(question, source_url, answer) as CACHE rows.

    answered is (question, engine, failed, results): a row for each engine that was asked.  Results of engines that failed or were not
    asked are empty.  exit_code is 0 with any result, 3 where all engines failed, else 4."""
    one = answered.groupBy(F.col("question").alias("_q"), "engine").agg(F.max("failed").alias("failed"), F.first(F.when(~F.col("failed"), F.col("results")), True).alias("results"))
    per = one.groupBy("_q").agg(F.map_from_entries(F.collect_list(F.struct("engine", F.struct("failed", "results")))).alias("by"))
    rows = questions.join(per, F.col("question") == F.col("_q"), "left")
    none = F.array().cast(RECORD)
    results = [F.coalesce(F.try_element_at("by", F.lit(e))["results"], none) for e in ENGINES]
    failures = sum((F.when(F.coalesce(F.try_element_at("by", F.lit(e))["failed"], F.lit(True)), 1).otherwise(0) for e in ENGINES), F.lit(0))
    found = sum((F.size(r) for r in results), F.lit(0))
    code = F.when(found > 0, 0).when(failures == len(ENGINES), 3).otherwise(4)
    pairs = F.map_from_arrays(F.array(*[F.lit(e) for e in ENGINES]), F.array(*results))
    return rows.select("question", "source_url", "answer", pairs.alias("engine_results"), now.cast("string").alias("cached_at"), code.cast("int").alias("exit_code"))


def write_cache(rows: DataFrame, folder: str) -> None:
    """Adds CACHE rows to a folder as JSON lines, in subfolders by the first two digits of the question's key; nothing there is rewritten."""
    rows.withColumn("part", F.substring(question_key(F.col("question")), 1, 2)).write.mode("append").partitionBy("part").json(folder)


def engine_lists(cached: DataFrame) -> DataFrame:
    """The ranked lists (query_id, engine, engine_ord, rank, url, title, snippet) of cached questions; engines in the order of their names, ids are keys."""
    one = cached.select(question_key(F.col("question")).alias("query_id"), F.explode("engine_results").alias("engine", "results"))
    rows = one.select("query_id", "engine", F.posexplode("results").alias("rank", "r"))
    order = F.array_position(F.array(*[F.lit(e) for e in sorted(ENGINES)]), F.col("engine")).cast("int")
    return rows.select("query_id", "engine", order.alias("engine_ord"), F.col("rank").cast("bigint").alias("rank"), "r.*")


def split_reference(question: Column) -> tuple[Column, Column]:
    """(question, first URL) of a text that ends in its reference URLs; the URL is null where there are none."""
    parts = F.split(question, REFERENCE_MARK)
    there = F.size(parts) > 1
    return F.when(there, F.trim(F.get(parts, F.lit(0)))).otherwise(question), F.when(there, F.trim(F.get(parts, F.lit(1))))


def convert_questions(table: DataFrame, path: str) -> None:
    """Writes a table with a column question, URLs included, as JSON lines that load_questions() reads."""
    question, url = split_reference(F.col("question"))
    table.withColumn("source_url", url).withColumn("question", question).write.mode("errorifexists").json(path)
