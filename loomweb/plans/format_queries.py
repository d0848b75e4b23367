"""Output shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import formats
from .base import LEAN, _page, _worded, _worded_sql, query, read
from .text_queries import LINES
HEAD = "'# --- [Source: https://e.com/' || doc_id || '] ---' || chr(10) || chr(10)"


@query(f"select doc_id, {HEAD} || '- [Generic Page](https://e.com/' || doc_id || ')' as compact, {HEAD} || case when length(text) > 2000 then substr(text, 1, 2000) || '... (truncated)' else text end as standard, {HEAD} || text as whole from documents")
def fmt_generic_tiers(spark, sf_dir):
    source = F.concat(F.lit("https://e.com/"), F.col("doc_id").cast("string"), F.lit("?utm_source=x#f"))
    return read(spark, sf_dir, "documents").select("doc_id", *[formats.tier(source, F.col("text"), d).alias(n) for d, n in ((1, "compact"), (2, "standard"), (3, "whole"))])


@query(f"select doc_id, '---' || chr(10) || 'source: ' || source || chr(10) || 'title: ' || lang || chr(10) || 'type: document' || chr(10) || 'fetched: unknown' || chr(10) || '---' || chr(10) || chr(10) || {LEAN.format('text')} as block from documents")
def fmt_structured(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", formats.structured(F.col("source"), F.col("lang"), "document", F.col("text")).alias("block"))


BARE = r"trim(regexp_replace(trim(regexp_replace(trim(regexp_replace({0}, '^#+', '')), '^>+', '')), '^(?:- )*(?:\* )*', ''))"


@query(f"""select doc_id, list_filter(list_transform(list_filter(list_transform({LINES}, lambda v: trim(v)), lambda v: not (starts_with(v, '<!--') or v = '---' or starts_with(v, '# --- [Source:'))), lambda v: {BARE.format("v")}), lambda v: v <> '')[1] as title from documents""")
def fmt_title_infer(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.title_line(F.col("text")).alias("title"))


@query(_worded_sql(3) + "select doc_id, '---' || chr(10) || 'source: https://e.com/' || doc_id || chr(10) || 'title: ' || case when doc_id % 2 = 0 then w1 || ' ' || w2 else 'https://e.com/' || doc_id end || chr(10) || 'type: generic' || chr(10) || 'fetched: unknown' || chr(10) || '---' || chr(10) || chr(10) || case when doc_id % 2 = 0 then '<!-- ' || w0 || ' -->' || chr(10) || '---' || chr(10) || '## > - ' || w1 || ' ' || w2 else '---' end as block from t")
def fmt_dispatch(spark, sf_dir):
    body = F.when(F.col("doc_id") % 2 == 0, _page("<!-- {w0} -->\n---\n## > - {w1} {w2}\n")).otherwise("---")
    return _worded(spark, sf_dir, 3).select("doc_id", formats.formatted(body, F.concat(F.lit("https://e.com/"), F.col("doc_id").cast("string")), "structured").alias("block"))


@query("select lang, count(*) as pages, sum(strlen(text))::bigint as bytes, cast(sum((strlen(text) + 3) // 4) as bigint) as token_estimate from documents group by 1")
def stat_totals(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("pages"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.floor((F.octet_length("text") + 3) / 4)).alias("token_estimate"))


PLAIN_LINE = r"rtrim(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(case when {0} like '#%' then ltrim(regexp_replace({0}, '^#+', '')) when ltrim({0}) like '#%' then ltrim({0}) else {0} end, '^[ \t]*(?:> )+', ''), '^[ \t]*[-*] ', ''), '^[ \t]*[0-9]+\.[ \t]+', ''), '\[([^\]]+)\]\(([^)]+)\)', '\1 (\2)', 'g'), '**', ''), '__', ''), '`', ''))"


@query(f"""with l as (select doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: not (starts_with(trim(x), '<!--') or trim(x) = '---')), lambda x: {PLAIN_LINE.format("x")}) as ls from documents),
j as (select doc_id, regexp_replace(array_to_string(ls, chr(10)), '\\n([ \\t\\r]*)\\n(?:[ \\t\\r]*\\n)+', chr(10) || '\\1' || chr(10), 'g') as t from l)
select doc_id, {LEAN.format("t")} as plain from j""")
def fmt_plain(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", formats.plain(F.col("text")).alias("plain"))


@query(_worded_sql(8) + """select doc_id, 'Source: ' || w0 || chr(10) || chr(10) || w1 || ' ' || w2 || chr(10) || w3 || chr(10) || w4 || chr(10) || w5 || chr(10) || '# ' || w6 || '  **x**' || chr(10) || chr(10) || 'see ' || w7 || ' (/y) code' as plain from t""")
def fmt_plain_marks(spark, sf_dir):
    text = _page("<!-- c -->\n# --- [Source: {w0}] ---\n\n\n## {w1} **{w2}**\n---\n> > {w3}\n- {w4}\n 12. {w5}\n```sh\n# {w6}  **x**\n```\n\nsee [{w7}](/y) `code`  \n")
    return _worded(spark, sf_dir, 8).select("doc_id", formats.plain(text).alias("plain"))
