"""Payloads, made of the tables and parsed again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import html, platforms
from ..sources import adapters
from .base import _page, _worded, _worded_sql, query, read
from .ranked_queries import ENGINES, engines


@query(ENGINES + "select query_id, engine, engine_ord, rank, url, title, snippet from e where rank < 4")
def parse_engines(spark, sf_dir):
    lists = engines(spark, sf_dir)
    found = None
    for ord_, (name, field) in enumerate((("e1", "content"), ("e2", "description"), ("e3", "content"))):
        rows = lists.where(F.col("engine") == name).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "url", "title", F.col("snippet").alias(field), F.lit(0.5).alias("quality")))).alias("results"))
        one = adapters.engine_results(rows.select("query_id", F.to_json(F.struct("results")).alias("raw")), "raw", name, ord_, field, 4)
        found = one if found is None else found.unionByName(one)
    return found


#: Titles without what HTML would read.
SAFE = "trim(regexp_replace(title, '[^A-Za-z ]', '', 'g'))"


@query(ENGINES + f"""select query_id, 'lite' as engine, rank - skipped as rank, url, t as title from (select query_id, rank, url, t, count(*) filter (t = '') over (partition by query_id order by rank) as skipped from (select query_id, rank, url, {SAFE} as t from e where engine = 'e1')) where t <> '' and rank - skipped < 6""")
def parse_result_pages(spark, sf_dir):
    lists = engines(spark, sf_dir).where("engine = 'e1'")
    title = F.trim(F.regexp_replace("title", "[^A-Za-z ]", ""))
    href = F.when(F.col("rank") % 2 == 0, F.concat(F.lit("/l/?uddg="), F.url_encode("url"), F.lit("&amp;rut=abc"))).otherwise(F.col("url"))
    anchor = F.concat(F.lit('<tr><td><a rel="nofollow" class="big result__a" href="'), href, F.lit('">'), title, F.lit('</a><a class="result__a" href="'), href, F.lit('">again</a></td></tr>'))
    rows = lists.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", anchor.alias("a")))).alias("xs"))
    raw = F.concat(F.lit('<html><a href="/settings">s</a><table>'), F.array_join(F.transform("xs", lambda x: x["a"]), "\n"), F.lit("</table>"))
    pages = rows.select("query_id", raw.alias("raw"))
    return html.search_results(pages, "raw", "lite", 0, 6).where("title <> 'again'").select("query_id", "engine", "rank", "url", "title")


SUMMARY = "substr(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), 1, 80)"


def _summary() -> Column:
    return F.substring(F.regexp_replace("text", r"[\r\n]+", " "), 1, 80)


@query(f"select doc_id, '# T' || doc_id || chr(10) || chr(10) || case when doc_id % 3 = 0 then '' else '_' || source || '_' || chr(10) || chr(10) end as brief, '# T' || doc_id || chr(10) || chr(10) || case when doc_id % 3 = 0 then '' else '_' || source || '_' || chr(10) || chr(10) end || {SUMMARY} as made from documents")
def parse_wiki(spark, sf_dir):
    payload = F.to_json(F.struct(F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("description"), _summary().alias("extract"), F.lit(1).alias("pageid")))
    return read(spark, sf_dir, "documents").select("doc_id", payload.alias("p")).select("doc_id", adapters.wikipedia(F.col("p"), 1).alias("brief"), adapters.wikipedia(F.col("p")).alias("made"))


#: Conversations as issues: the first turn is the issue, the others are comments.
ISSUES = f"""with c as (select conv_id, turn, role, case when turn % 4 = 3 then null else {SUMMARY} end as body, row_number() over (partition by conv_id order by turn) as n from conversations),
i as (select c.conv_id, c.role, c.body, coalesce(list_filter(['bug', case when c.conv_id % 2 = 0 then 'help' end], lambda x: x is not null), []) as labels from c where n = 1)
"""
ISSUE_HEAD = "'# [#' || i.conv_id || '] T' || i.conv_id || chr(10) || '**Labels**: ' || array_to_string(i.labels, ', ') || chr(10) || '**Author**: ' || i.role || chr(10) || chr(10) || coalesce(i.body, '')"


@query(ISSUES + f"""select i.conv_id, '- [#' || i.conv_id || '] T' || i.conv_id || ' [Labels: ' || array_to_string(i.labels, ', ') || ']' || chr(10) as line, {ISSUE_HEAD} as head,
 {ISSUE_HEAD} || chr(10) || chr(10) || '## Comments' || chr(10) || chr(10) || coalesce((select string_agg('### ' || c.role || chr(10) || coalesce(c.body, '') || chr(10) || chr(10) || '---' || chr(10) || chr(10), '' order by c.n) from c where c.conv_id = i.conv_id and c.n > 1), '') as whole from i""")
def parse_github_issue(spark, sf_dir):
    from pyspark.sql import Window

    body = F.when(F.col("turn") % 4 != 3, _summary())
    turns = read(spark, sf_dir, "conversations").select("conv_id", "role", body.alias("body"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("place"))
    names = F.filter(F.array(F.lit("bug"), F.when(F.col("conv_id") % 2 == 0, "help")), lambda x: x.isNotNull())
    labels = F.transform(names, lambda x: F.struct(x.alias("name")))
    payload = F.to_json(F.struct(F.col("conv_id").alias("number"), F.concat(F.lit("T"), F.col("conv_id").cast("string")).alias("title"), "body", labels.alias("labels"), F.struct(F.col("role").alias("login")).alias("user")))
    issues = turns.where("place = 1").select(F.col("conv_id").alias("key"), adapters.issue(payload).alias("i"))
    comments = turns.where("place > 1").select(F.col("conv_id").alias("key"), "place", F.col("role").alias("login"), "body")
    made = lambda d: platforms.issue(F.col("i.number"), F.col("i.title"), F.col("i.labels"), F.col("i.author"), F.col("i.body"), F.col("comments"), d)
    return adapters.with_comments(issues, comments).select(F.col("key").alias("conv_id"), *[made(d).alias(n) for d, n in ((1, "line"), (2, "head"), (3, "whole"))])


@query("""with d as (select *, row_number() over (partition by source order by doc_id) as n from documents)
select source, '# Issues for o/' || source || chr(10) || chr(10) || string_agg('- [#' || doc_id || '] T' || doc_id || ' (https://github.com/o/' || source || '/issues/' || doc_id || ') [Labels: ' || lang || ', x]' || chr(10), '' order by n) filter (n <= 20) as made from d group by 1""")
def fmt_issues(spark, sf_dir):
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "documents").withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where(F.col("n") <= platforms.ISSUES)
    number = F.col("doc_id").cast("string")
    one = F.struct("n", F.col("doc_id").alias("number"), F.concat(F.lit("T"), number).alias("title"), F.concat(F.lit("https://github.com/o/"), F.col("source"), F.lit("/issues/"), number).alias("html_url"), F.array(F.col("lang"), F.lit("x")).alias("labels"))
    return rows.groupBy("source").agg(F.sort_array(F.collect_list(one)).alias("rows")).select("source", platforms.issues(F.lit("o"), F.col("source"), F.col("rows")).alias("made"))


@query("""select page_id, case when page_id % 4 = 0 or page_id % 5 = 0 then null else url end as snapshot, case when page_id % 4 = 0 or page_id % 5 = 0 then null else '2020-0' || (1 + page_id % 9) || '-11' end as day, case when page_id % 3 = 0 then null else '20240229120000' end as asked from pages""")
def parse_wayback(spark, sf_dir):
    closest = F.struct((F.col("page_id") % 4 != 0).alias("available"), F.when(F.col("page_id") % 5 == 0, "404").otherwise("200").alias("status"), "url", F.concat(F.lit("20200"), (1 + F.col("page_id") % 9).cast("string"), F.lit("11235959")).alias("timestamp"))
    payload = F.to_json(F.struct(F.struct(closest.alias("closest")).alias("archived_snapshots")))
    found = adapters.wayback(F.col("p"))
    date = F.when(F.col("page_id") % 3 == 0, "2023-02-29").otherwise("2024-02-29")
    return read(spark, sf_dir, "pages").select("page_id", payload.alias("p")).select("page_id", found["url"].alias("snapshot"), found["date"].alias("day"), adapters.wayback_timestamp(date).alias("asked"))


@query(f"""with l as (select conv_id, turn, turn * 701 as s, trim({SUMMARY}) as t from conversations)
select conv_id, coalesce(string_agg('**[' || case when s >= 3600 then lpad((s // 3600)::varchar, 2, '0') || ':' else '' end || lpad((s % 3600 // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') || ']** ' || t, chr(10) order by turn) filter (t <> ''), '') as lines from l group by 1""")
def parse_captions(spark, sf_dir):
    escaped = F.replace(F.replace(F.replace(F.replace(F.replace(_summary(), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#39;"))
    one = F.concat(F.lit('<text start="'), (F.col("turn") * 701).cast("string"), F.when(F.col("turn") % 2 == 0, ".25").otherwise(""), F.lit('" dur="1.5"> '), escaped, F.lit("</text>"))
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", one.alias("x")))).alias("xs"))
    return rows.select("conv_id", adapters.captions(F.concat(F.lit("<transcript>"), F.array_join(F.transform("xs", lambda x: x["x"]), ""), F.lit("</transcript>"))).alias("lines"))


@query("select page_id, case when page_id % 3 = 0 then null else 'https://v.x/api?v=' || page_id || '&lang=en' end as track, 'T' || page_id as title, 'A' || page_id as channel from pages")
def parse_video(spark, sf_dir):
    number = F.col("page_id").cast("string")
    watch = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit('x"captionTracks":[{"baseUrl":"https://v.x/api?v='), number, F.lit('\\u0026lang=en","name":"e"},{"baseUrl":"other"}]'))).otherwise('"baseUrl":"no"')
    card = adapters.oembed(F.to_json(F.struct(F.concat(F.lit("T"), number).alias("title"), F.concat(F.lit("A"), number).alias("author_name"), F.lit("u").alias("author_url"))))
    return read(spark, sf_dir, "pages").select("page_id", adapters.caption_url(watch).alias("track"), card["title"].alias("title"), card["author_name"].alias("channel"))


CELL = r"trim(regexp_replace(replace({0}, '|', '\|'), '\s+', ' ', 'g'))"


@query(f"""with c as (select conv_id, turn, {CELL.format("substr(role || '|' || text, 1, 40)")} as t, role from conversations)
select conv_id, case when conv_id % 10 = 0 then '| result |' || chr(10) || '| --- |' || chr(10) || '| No columns returned |' else '| turn | said | who |' || chr(10) || '| --- | --- | --- |' || chr(10) ||
 case when conv_id % 10 = 1 then '| No rows returned |  |  |' || chr(10) else string_agg('| ' || turn || ' | ' || t || ' | ' || case when turn % 2 = 0 then role else '' end || ' |', chr(10) order by turn) end end as made from c group by 1""")
def parse_sparql_table(spark, sf_dir):
    value = lambda c: F.struct(c.alias("value"))
    cells = F.map_from_entries(F.filter(F.array(F.struct(F.lit("turn"), value(F.col("turn").cast("string"))), F.struct(F.lit("said"), value(F.substring(F.concat("role", F.lit("|"), "text"), 1, 40))), F.struct(F.when(F.col("turn") % 2 == 0, "who").otherwise("other"), value(F.col("role")))), lambda x: x.isNotNull()))
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.to_json(cells).alias("j")))).alias("xs"))
    body = F.when(F.col("conv_id") % 10 == 1, "").otherwise(F.array_join(F.transform("xs", lambda x: x["j"]), ","))
    names = F.when(F.col("conv_id") % 10 == 0, "").otherwise('"turn","said","who"')
    return rows.select("conv_id", adapters.sparql_table(F.concat(F.lit('{"head":{"vars":['), names, F.lit(']},"results":{"bindings":['), body, F.lit("]}}"))).alias("made"))


PLAINER = "trim(regexp_replace(regexp_replace(substr({0}, 1, 70), '[^A-Za-z ]', ' ', 'g'), ' +', ' ', 'g'))"


def _plainer() -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.substring("text", 1, 70), "[^A-Za-z ]", " "), " +", " "))


REPLIES = f"with a as (select conv_id, turn, {PLAINER.format('text')} as t, length(text) % 11 - 3 as score, turn % 5 = 2 as ok from conversations), o as (select *, row_number() over (partition by conv_id order by not ok, -score, turn) as n from a)\n"
REPLY = "case when ok then '### ✅ Accepted Answer [Score: ' else '### [Score: ' end || score || ']' || chr(10) || chr(10) || '**' || t || '** [x](/u) `c`' || chr(10) || chr(10) || '---' || chr(10) || chr(10)"


@query(REPLIES + f"select conv_id, {', '.join(f"""'# Q' || conv_id || chr(10) || chr(10) || '## Answers' || chr(10) || chr(10) || coalesce(string_agg({REPLY}, '' order by n) filter (n <= {k} and conv_id % 7 <> 0), '') as {name}""" for k, name in ((1, 'best'), (3, 'some'), (10**9, 'every')))} from o group by conv_id")
def parse_so_sorted(spark, sf_dir):
    body = F.concat(F.lit("<p><strong>"), _plainer(), F.lit('</strong> <a href="/u" rel="n">x</a> <code>c</code></p>\n'))
    one = F.struct("turn", body.alias("body"), (F.length("text") % 11 - 3).alias("score"), (F.col("turn") % 5 == 2).alias("is_accepted"))
    rows = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("key")).agg(F.sort_array(F.collect_list(one)).alias("items"))
    replies = rows.where("key % 7 <> 0").select("key", F.to_json(F.struct("items")).alias("payload"))
    questions = rows.select("key", F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("Q"), F.col("key").cast("string")).alias("title"))).alias("items"))).alias("payload"))
    found = adapters.with_answers(questions, replies)
    return found.select(F.col("key").alias("conv_id"), *[platforms.answers(F.col("title"), F.col("answers"), d).alias(n) for d, n in ((1, "best"), (2, "some"), (3, "every"))])


RULED = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
THREAD = f"with c as (select conv_id, turn, {PLAINER.format('text')} as t, length(text) % 5 - 1 as score, turn % 6 <> 5 as own from conversations), k as (select *, row_number() over (partition by conv_id order by turn) as n from c where t <> '' and ({{0}}))\n"


def _comments(some: str, every: str) -> str:
    said = lambda cut, name: f"'# T' || c.conv_id || any_value({some}) || coalesce(chr(10) || chr(10) || '## Comments' || chr(10) || chr(10) || string_agg(k.t, {RULED} order by k.n) filter (k.n <= {cut}), '') as {name}"
    return f"select c.conv_id, '- [T' || c.conv_id || ']' as title, {said(every, 'some')}, {said(10**9, 'whole')} from (select distinct conv_id from c) c left join k using (conv_id) group by c.conv_id"


@query(THREAD.format("score > 0 and own") + _comments("chr(10) || chr(10) || case when c.conv_id % 2 = 0 then 'self' else '' end", "2"))
def parse_reddit(spark, sf_dir):
    one = F.struct("turn", F.when(F.col("turn") % 6 != 5, "t1").otherwise("more").alias("kind"), F.struct(F.concat(F.lit(" "), _plainer()).alias("body"), (F.length("text") % 5 - 1).alias("score")).alias("data"))
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("xs"))
    post = F.struct(F.lit("t3").alias("kind"), F.struct(F.concat(F.lit("T"), F.col("conv_id").cast("string")).alias("title"), F.when(F.col("conv_id") % 2 == 0, "self").otherwise("").alias("selftext")).alias("data"))
    listing = lambda x: F.to_json(F.struct(F.struct(x.alias("children")).alias("data")))
    payload = F.concat(F.lit("["), listing(F.array(post)), F.lit(","), listing(F.transform("xs", lambda x: F.struct(x["kind"].alias("kind"), x["data"].alias("data")))), F.lit("]"))
    r = adapters.reddit(F.col("p"))
    return rows.select("conv_id", payload.alias("p")).select("conv_id", *[platforms.reddit(r["title"], r["selftext"], r["comments"], d).alias(n) for d, n in ((1, "title"), (2, "some"), (3, "whole"))])


@query(THREAD.format("own") + _comments("case when c.conv_id % 2 = 0 then chr(10) || chr(10) || 'a b' else '' end", "5"))
def parse_hn(spark, sf_dir):
    one = F.struct("turn", F.when(F.col("turn") % 6 != 5, F.concat(F.lit("<p>"), _plainer(), F.lit("</p>"))).alias("text"))
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("children"))
    payload = F.to_json(F.struct(F.concat(F.lit("T"), F.col("conv_id").cast("string")).alias("title"), F.when(F.col("conv_id") % 2 == 0, "<p>a</p><i>b</i>").otherwise("<p> </p>").alias("text"), "children"))
    h = adapters.hacker_news(F.col("p"))
    return rows.select("conv_id", payload.alias("p")).select("conv_id", *[platforms.hacker_news(h["title"], h["text"], h["comments"], d).alias(n) for d, n in ((1, "title"), (2, "some"), (3, "whole"))])


@query(_worded_sql(6) + """, x as (select *, case when doc_id % 5 = 0 then 'Unknown' when doc_id % 5 = 4 then w0 || ' et al.' else array_to_string(list_slice([w0, w1, w2], 1, doc_id % 5), ', ') end as names from t)
select doc_id, '- [' || w3 || ' ' || w4 || '](http://a/' || doc_id || ')' as line, '# ' || w3 || ' ' || w4 || chr(10) || chr(10) || '## Abstract' || chr(10) || chr(10) || w5 as brief,
 '# ' || w3 || ' ' || w4 || chr(10) || chr(10) || '**Authors:** ' || names || chr(10) || '**Published:** 2020-02-03' || chr(10) || '**ArXiv:** http://a/' || doc_id || chr(10) || chr(10) || '## Abstract' || chr(10) || chr(10) || w5 as whole from x""")
def parse_arxiv(spark, sf_dir):
    names = F.slice(F.array("w0", "w1", "w2", "w3"), 1, (F.col("doc_id") % 5).cast("int"))
    people = F.array_join(F.transform(names, lambda x: F.concat(F.lit("<author><name>"), x, F.lit("</name></author>"))), "")
    atom = F.concat(F.lit("<feed><title>ArXiv Query</title><id>f</id><entry><id>http://a/"), F.col("doc_id").cast("string"), F.lit("</id><published>2020-02-03T00:00:00Z</published><title> "), F.col("w3"), F.lit("\n"), F.col("w4"), F.lit("</title><summary> "), F.col("w5"), F.lit("\n</summary>"), people, F.lit("</entry></feed>"))
    a = adapters.arxiv(F.col("p"))
    rows = _worded(spark, sf_dir, 6).select("doc_id", atom.alias("p"))
    return rows.select("doc_id", *[platforms.paper(a["title"], a["authors"], a["published"], a["abstract"], a["id"], d).alias(n) for d, n in ((1, "line"), (2, "brief"), (3, "whole"))])


VIDEO = "'# T' || doc_id || chr(10) || chr(10) || '**Channel:** [' || source || '](https://c/' || source || ')' || chr(10)"


@query(f"""with x as (select doc_id, source, case when doc_id % 6 = 0 then '' else regexp_replace(text, '[^A-Za-z ]', '', 'g') end as t from documents)
select doc_id, {VIDEO} as card, {VIDEO} || case when t = '' then '' else chr(10) || '## Transcript Snippet' || chr(10) || chr(10) || substr(t, 1, 500) || case when strlen(t) > 500 then '... (truncated)' else '' end end as some,
 {VIDEO} || case when t = '' then '' else chr(10) || '## Transcript' || chr(10) || chr(10) || t end as whole from x""")
def fmt_youtube(spark, sf_dir):
    said = F.when(F.col("doc_id") % 6 == 0, "").otherwise(F.regexp_replace("text", "[^A-Za-z ]", ""))
    made = lambda d: platforms.video(F.concat(F.lit("T"), F.col("doc_id").cast("string")), F.col("source"), F.concat(F.lit("https://c/"), F.col("source")), said, d)
    return read(spark, sf_dir, "documents").select("doc_id", *[made(d).alias(n) for d, n in ((1, "card"), (2, "some"), (3, "whole"))])


@query(_worded_sql(6) + """select doc_id, '# ' || w0 || chr(10) || '### ' || w3 as heads, '# ' || w0 || chr(10) || '```' || chr(10) || w2 || chr(10) || '```' || chr(10) || '### ' || w3 || chr(10) || '#' || w4 || chr(10) as code,
 '# ' || w0 || chr(10) || w1 || chr(10) || '```' || chr(10) || w2 || chr(10) || '```' || chr(10) || '### ' || w3 || chr(10) || '#' || w4 || chr(10) || w5 as whole from t""")
def fmt_readme(spark, sf_dir):
    text = _page("# {w0}\n{w1}\n```\n{w2}\n```\n### {w3}\n#{w4}\n{w5}")
    return _worded(spark, sf_dir, 6).select("doc_id", *[platforms.readme(text, d).alias(n) for d, n in ((1, "heads"), (2, "code"), (3, "whole"))])


DATE = "concat(1995 + event_id % 40, '-', case when event_id % 14 < 10 then '0' else '' end, event_id % 14, '-', case when event_id % 33 < 10 and event_id % 7 > 0 then '0' else '' end, event_id % 33)"


@query(f"with d as (select event_id, {DATE} as date from events) select event_id, date, coalesce(regexp_full_match(date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') and try_cast(date as date) is not null, false) as valid from d")
def date_validate(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.expr(DATE).alias("date")).withColumn("valid", adapters.valid_date(F.col("date")))
