"""Crawls, archived pages, caches, cascades, batches and session logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions import values as V
from ..operators import cascade, crawl, find
from ..sources import adapters
from .base import query, read
from .url_queries import ROUTED, _inputs
#: A site per remainder of 7; each page links to the next ones of its site, to itself, to another site and to a page that is not there.
SITE = "concat('https://d', {0} % 7, '.x/p', {0})"
GRAPH = f"""with recursive n as (select page_id as id, {SITE.format("page_id")} as url from pages),
l as (select id, id + 7 as goal, 1 as ord from n union all select id, id + 14, 3 from n union all select id, id, 0 from n),
w as (select id as seed, id, 0 as depth, [0] as way from n where id < 7 union all select w.seed, l.goal, w.depth + 1, list_append(w.way, l.ord) from w join l on l.id = w.id join n on n.id = l.goal where w.depth < 3),
v as (select seed, id, min(depth) as depth, arg_min(way, (depth, way)) as way from w group by 1, 2),
o as (select seed, id, depth, row_number() over (partition by seed order by depth, way) as ord from v)
"""


def _site(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    pages = read(spark, sf_dir, "pages").select("page_id", F.expr(SITE.format("page_id")).alias("url"))
    hrefs = F.array(F.lit("#self"), F.concat(F.lit("/p"), (F.col("page_id") + 7).cast("string")), F.concat(F.lit("//d"), ((F.col("page_id") + 1) % 7).cast("string"), F.lit(".x/p"), (F.col("page_id") + 1).cast("string")), F.concat(F.lit("./x/../p"), (F.col("page_id") + 14).cast("string"), F.lit("/")), F.lit("missing"))
    return pages, pages.select("url", F.posexplode(hrefs).alias("link_ord", "href"))


@query(GRAPH + f"select {SITE.format('seed')} as seed, {SITE.format('id')} as url, depth, ord from o where ord <= 5")
def crawl_bfs_budget(spark, sf_dir):
    pages, links = _site(spark, sf_dir)
    return crawl.crawl(pages.where("page_id < 7").select(F.col("url").alias("seed")), links, pages.select("url"), max_depth=3, max_pages=5)


@query(GRAPH + f"""select {SITE.format('seed')} as seed, string_agg(chr(10) || chr(10) || '# --- [Source: ' || {SITE.format('id')} || '] ---' || chr(10) || chr(10) || 'text of ' || id, '' order by ord) as text, count(*) as n_pages from o where ord <= 5 group by seed""")
def crawl_joined_pages(spark, sf_dir):
    pages, links = _site(spark, sf_dir)
    found = crawl.crawl(pages.where("page_id < 7").select(F.col("url").alias("seed")), links, pages.select("url"), max_depth=3, max_pages=5)
    texts = pages.select(F.col("url").alias("_u"), F.concat(F.lit("text of "), F.col("page_id").cast("string")).alias("text"))
    return cascade.joined_pages(found.join(texts, F.col("url") == F.col("_u")))


EVENTS = "a as (select * from events where event_type = (select min(event_type) from events)), b as (select * from events where event_type = (select max(event_type) from events))"


@query(f"with {EVENTS} select a.event_id, arg_min(b.event_id, (abs(epoch_us(b.ts) - epoch_us(a.ts)), b.ts, b.event_id)) as nearest_id from a join b on a.user_id = b.user_id group by 1")
def asof_snapshot_nearest(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ends = events.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))  # one row
    wanted = events.join(F.broadcast(ends), F.col("event_type") == F.col("lo")).select("event_id", F.col("user_id").alias("key"), F.col("ts").alias("at"))
    seen = events.join(F.broadcast(ends), F.col("event_type") == F.col("hi")).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"))
    return adapters.nearest_snapshots(wanted, seen).where("nearest_id is not null").select("event_id", "nearest_id")


#: Archived states of a user's page: one per event of the last type, asked for by dates of which some are none.
ASKED = "case when event_id % 10 = 0 then '2024-13-01' when event_id % 10 = 1 then 'yesterday' else substr(cast(ts as string), 1, 10) end"


@query(f"""with {EVENTS}, w as (select distinct 'u' || user_id as url, {ASKED.replace("as string", "as varchar")} as date, user_id from a),
x as (select url, date, user_id, case when regexp_full_match(date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then try_cast(date as date) end as d from w),
y as (select x.url, x.date, x.d, arg_min(b.event_id, (abs(epoch_us(b.ts) - epoch_us(d + interval 12 hour)), b.ts, b.event_id)) as id, arg_min(b.ts, (abs(epoch_us(b.ts) - epoch_us(d + interval 12 hour)), b.ts, b.event_id)) as ts from x left join b on b.user_id = x.user_id and d is not null group by all)
select url, date, case when id is not null then 's' || lpad(id::varchar, 9, '0') end as snapshot_url, strftime(ts, '%Y-%m-%d') as snapshot_date,
 case when id is not null then '> **Archived snapshot** requested `' || date || '` → `' || strftime(ts, '%Y-%m-%d') || '` ([Wayback URL](s' || lpad(id::varchar, 9, '0') || '))' || chr(10) || chr(10) || 'state ' || id end as text, case when d is null then 'Config' when id is null then 'NoContent' end as error from y""")
def asof_pages(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("url", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    ends = events.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))  # one row
    wanted = events.join(F.broadcast(ends), F.col("event_type") == F.col("lo")).select("url", F.expr(ASKED).alias("date")).distinct()
    seen = events.join(F.broadcast(ends), F.col("event_type") == F.col("hi"))
    seen = seen.select("url", "ts", F.concat(F.lit("s"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("snapshot_url"), F.concat(F.lit("state "), F.col("event_id").cast("string")).alias("text"))
    return cascade.as_of(wanted, seen)


#: Bodies stored an hour or a week before they are asked for, or never.
STORED = "case when page_id % 3 = 0 then 3600 when page_id % 3 = 1 then 604800 end"


@query(f"select page_id, coalesce({STORED} <= 86400, false) as cache_hit, case when {STORED} <= 86400 then 'body ' || page_id end as body from pages")
def cache_fresh_bodies(spark, sf_dir):
    at = F.timestamp_seconds(F.lit(1_700_000_000))
    rows = read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://e.com/p"), F.col("page_id").cast("string"), F.lit("/?ref=x#f")).alias("url"))
    clean = F.concat(F.lit("https://e.com/p"), F.col("page_id").cast("string"))
    stored = rows.select(urls.cache_key(clean).alias("key"), F.concat(F.lit("body "), F.col("page_id").cast("string")).alias("body"), F.timestamp_seconds(F.lit(1_700_000_000) - F.expr(STORED)).alias("stored_at")).where("stored_at is not null")
    older = stored.withColumn("body", F.lit("old")).withColumn("stored_at", F.timestamp_seconds(F.lit(1_000_000_000)))
    return cascade.with_cached(rows.withColumn("at", at), stored.unionByName(older), 86400).select("page_id", "cache_hit", "body")


@query("""with x as (select page_id, page_id % 6 as k, 'https://d' || page_id || '.x/guide' as u from pages)
select page_id, case k when 0 then 'markdown' when 1 then 'markdown' when 2 then 'llms' when 5 then null else 'crawl' end as source,
 '# --- [Source: ' || u || '] ---' || chr(10) || chr(10) || case k when 0 then 'twin' when 1 then 'folder' when 2 then 'index' when 3 then 'short' when 4 then repeat('long ', 40) end as text,
 case when k = 4 then 2 when k < 5 then 1 end as n_pages, k = 3 as sparse from x""")
def page_cascade(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 6).alias("k"), F.concat(F.lit("https://d"), F.col("page_id").cast("string"), F.lit(".x/guide")).alias("url"))
    origin = F.substring_index("url", "/guide", 1)
    body = lambda at, text, kind="text/plain", status=200: F.struct(F.concat(*at).alias("url"), F.lit(status).alias("status"), F.lit(kind).alias("content_type"), F.lit(text).alias("body"))
    twin, folder, index = [F.col("url"), F.lit(".md")], [origin, F.lit("/index.html.md")], [origin, F.lit("/.well-known/llms.txt")]
    served = F.when(F.col("k") == 0, F.array(body(twin, "twin"), body(folder, "folder"))).when(F.col("k") == 1, F.array(body(twin, "masked", "text/html"), body(folder, "folder", "text/markdown"), body(index, "index")))
    served = served.when(F.col("k") == 2, F.array(body(twin, "gone", status=404), body(folder, "  "), body(index, "index"))).otherwise(F.array(body(twin, "gone", status=404)))
    crawled = rows.where("k in (0, 3, 4)").select("url", F.when(F.col("k") == 4, F.repeat(F.lit("long "), 40)).otherwise("short").alias("text"), F.when(F.col("k") == 4, 2).otherwise(1).alias("n_pages"))
    found = cascade.generic_text(rows, rows.select(F.inline(served)), crawled)
    return found.join(rows.select("page_id", F.col("url").alias("_u")), F.col("url") == F.col("_u")).select("page_id", "source", "text", "n_pages", "sparse")


@query("""with x as (select page_id, page_id % 4 as k, 'https://d' || page_id || '.x/a.html' as u from pages)
select page_id, case when k in (0, 1) then 'cloud' when k = 2 then 'crawl' end as source, case when k in (0, 1) then '<!-- Processed via Jina.ai Cloud Proxy -->' || chr(10) || chr(10) else '' end || '# --- [Source: ' || u || '] ---' || chr(10) || chr(10) || case when k in (0, 1) then 'read for ' || page_id when k = 2 then 'crawled' end as text from x""")
def page_cascade_cloud(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 4).alias("k"), F.concat(F.lit("https://d"), F.col("page_id").cast("string"), F.lit(".x/a.html")).alias("url"))
    status = F.when(F.col("k") == 2, 503).otherwise(200)
    bodies = rows.where("k < 3").select(F.concat(F.lit(V.CLOUD_READER), "url").alias("url"), status.alias("status"), F.lit("text/markdown").alias("content_type"), F.concat(F.lit("read for "), F.col("page_id").cast("string")).alias("body"))
    crawled = rows.where("k in (1, 2)").select("url", F.lit("crawled").alias("text"), F.lit(1).alias("n_pages"))
    found = cascade.generic_text(rows, bodies, crawled, allow_cloud=True)
    return found.join(rows.select("page_id", F.col("url").alias("_u")), F.col("url") == F.col("_u")).select("page_id", "source", "text")


LINE = "case page_id % 6 when 0 then concat('  ', url, ' ') when 1 then concat('h', page_id, '.x/p') when 2 then '   ' when 3 then concat('bad host/', page_id) when 4 then 'https://' else url end"
BATCH = f"with l as (select page_id as place, {LINE} as line from pages), t as (select place, trim(line) as t from l), u as (select place, case when regexp_matches(t, '^https?://') then t else 'https://' || t end as url from t where t <> ''), v as (select * from u where regexp_matches(url, '^https?://[^/?# ]+([/?#]|$)') order by place limit 40)\n"


@query(BATCH + "select place, url from v")
def batch_normalize(spark, sf_dir):
    return cascade.batch_urls(read(spark, sf_dir, "pages").select(F.col("page_id").alias("place"), F.expr(LINE).alias("line")), 40)


@query(BATCH + "select count(*) filter (place % 4 <> 0) as n_ok, string_agg('page ' || place, chr(10) || chr(10) order by place) filter (place % 4 <> 0) as merged, null::varchar as error from v")
def batch_merge(spark, sf_dir):
    wanted = cascade.batch_urls(read(spark, sf_dir, "pages").select(F.col("page_id").alias("place"), F.expr(LINE).alias("line")), 40)
    text = F.when(F.col("place") % 8 == 0, "  \n").when(F.col("place") % 4 != 0, F.concat(F.lit("page "), F.col("place").cast("string")))
    return cascade.batch_merge(wanted.select("place", text.alias("text")))


@query(ROUTED + """, k as (select *, case when page_id % 10 = 3 then 'Blocked' when page_id % 10 = 7 then 'NoContent' end as error from r), x as (select *, case when error is null then 'Found the words of ' || input end as text from k)
select cast(1700000000 + page_id as varchar) as timestamp, coalesce(platform, 'search') as source_type, strlen(coalesce(text, '')) as bytes, length(coalesce(text, '')) as output_chars, 'standard' as mode, page_id % 2 = 0 as cache_hit,
 case when text is null then '' else 'words' || case when contains(lower(text), 'join') then ',join' else '' end end as keywords, error is null as success, case error when 'Blocked' then 3 when 'NoContent' then 4 else 0 end as exit_code, error from x""")
def session_log_rows(spark, sf_dir):
    failed = F.when(F.col("page_id") % 10 == 3, "Blocked").when(F.col("page_id") % 10 == 7, "NoContent")
    done = _inputs(spark, sf_dir).select("input", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")).alias("at"), F.when(failed.isNull(), F.concat(F.lit("Found the words of "), F.col("input"))).alias("text"), F.lit(7).alias("tokens"), (F.col("page_id") % 2 == 0).alias("cache_hit"), failed.alias("error"))
    rows = cascade.session_entries(done, find.parse_terms("WORDS, join, absent"), 2)
    return rows.select("timestamp", "source_type", "bytes", "output_chars", "mode", "cache_hit", F.array_join("keywords_found", ",").alias("keywords"), "success", "exit_code", "error")
