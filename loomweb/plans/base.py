"""What the query modules share: the registry, table readers, SQL fragments and pages out of words."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
QUERIES: dict = {}
SQL: dict[str, str] = {}
N_QUERIES = 40


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors can write to and read."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or (spark.sparkContext.getCheckpointDir() or "")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomweb-")
    return f"{folder.rstrip('/')}/queries-{uuid.uuid4().hex}"


def _sql_list(items) -> str:
    return ", ".join("'" + str(x).replace("'", "''") + "'" for x in items)


def _any_host(host: str, domains) -> str:
    return " or ".join(f"({host} = '{d}' or {host} like '%.{d}')" for d in domains) or "false"


SCHEME, AUTH = "lower(regexp_extract(url, '^([a-z]+)://', 1))", "lower(regexp_extract(url, '^https?://([^/?#]*)', 1))"
PATH, QUERY, FRAGMENT = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)", r"regexp_extract(url, '^[^?#]*(\?[^#]*)', 1)", "regexp_extract(url, '(#.*)$', 1)"
PAIRS = f"list_filter(string_split(substr({QUERY}, 2), '&'), lambda p: p <> '' and string_split(p, '=')[1] not in ({_sql_list(V.TRACKING)}))"
KEPT = f"case when len({PAIRS}) > 0 then '?' || array_to_string({PAIRS}, '&') else '' end"
TRIMMED = f"rtrim({PATH}, '/')"
NORMAL = f"{SCHEME} || '://' || {AUTH} || case when {TRIMMED} = '' then '/' else {TRIMMED} end || {KEPT}"
FUSION_KEY = f"{SCHEME} || '://' || {AUTH} || {TRIMMED} || {QUERY} || {FRAGMENT}"
EVAL_KEY = f"{SCHEME} || '://' || {AUTH} || case when {TRIMMED} = '' then '/' else {TRIMMED} end || {QUERY}"
FAMILY_SQL = "case " + " ".join(f"when {' or '.join(f'contains({PATH}, {_sql_list([p])})' for p in parts)} then '{family}'" for family, parts in V.FAMILY_PATHS) + " end"
TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
#: Texts as words, from 0 on.
WORDS = "regexp_extract_all(text, '[A-Za-z]+')"


def _w(n: int, words: str = "ws") -> str:
    return f"coalesce({words}[{n + 1}], 'w{n}')"


def _worded(spark, sf_dir, n: int, name: str = "documents", id_col: str = "doc_id") -> DataFrame:
    """The id and the first n words w0, w1, ... of each text, with stand-ins where it has fewer."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    return read(spark, sf_dir, name).select(id_col, words.alias("ws")).select(id_col, *[F.coalesce(F.get("ws", F.lit(k)), F.lit(f"w{k}")).alias(f"w{k}") for k in range(n)])


def _worded_sql(n: int, name: str = "documents", id_col: str = "doc_id") -> str:
    return f"with d as (select {id_col}, {WORDS} as ws from {name}), t as (select {id_col}, " + ", ".join(f"{_w(k)} as w{k}" for k in range(n)) + " from d)\n"


def _page(template: str) -> Column:
    """Text with the names of words in braces."""
    return F.concat(*[F.col(x[1:-1]) if x.startswith("{") else F.lit(x) for x in re.split(r"(\{w[0-9]+\})", template) if x])


def _made(template: str) -> str:
    """The same as SQL for the twin."""
    return " || ".join(x[1:-1] if x.startswith("{") else "'" + x.replace("'", "''") + "'" for x in re.split(r"(\{w[0-9]+\})", template) if x)


LEAN = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
