"""Queries on URLs: equivalences, routing, platforms, probes, links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions import values as V
from ..operators import cascade, crawl
from ..sources import adapters
from .base import AUTH, EVAL_KEY, FAMILY_SQL, FUSION_KEY, KEPT, NORMAL, PATH, QUERY, SCHEME, query, read


@query(f"select page_id, {SCHEME} || '://' || {AUTH} || case when {PATH} = '' then '/' else {PATH} end || {KEPT} as clean_url from pages")
def url_strip_tracking(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.strip_tracking(F.col("url")).alias("clean_url"))


@query(f"select page_id, {NORMAL} as norm_url from pages")
def url_normalize(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.normalize(F.col("url")).alias("norm_url"))


@query(f"select page_id, {FUSION_KEY} as rrf_key from pages")
def url_rrf_key(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.fusion_key(F.col("url")).alias("rrf_key"))


@query(f"select page_id, {EVAL_KEY} as eval_key from pages")
def url_eval_key(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.eval_key(F.col("url")).alias("eval_key"))


@query(f"select page_id, {AUTH} as host from pages")
def url_host(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"))


@query(f"select page_id, (regexp_replace({AUTH}, '^www\\.', '') = 'example.org' or regexp_replace({AUTH}, '^www\\.', '') like '%.example.org') as on_site from pages")
def url_host_match_site(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.site_matches(urls.host(F.col("url")), " .www.Example.org").alias("on_site"))


@query(f"select page_id, sha256({NORMAL}) as cache_key from pages")
def url_cache_key(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.cache_key(F.col("url")).alias("cache_key"))


#: An input for each page, as SQL for either engine.
INPUT = """case page_id % 18 when 0 then concat('https://github.com/o', page_id, '/r', page_id, '/') when 1 then concat('https://github.com/o', page_id, '/r/issues/', page_id, '#c')
 when 2 then concat('https://github.com/o', page_id, '/r/pulls') when 3 then concat('https://github.com/o', page_id) when 4 then concat('https://www.reddit.com/r/x/comments/', page_id, '/?a=b#c')
 when 5 then concat('https://news.ycombinator.com/item?p=1&id=', page_id) when 6 then 'https://news.ycombinator.com/newest' when 7 then concat('https://en.wikipedia.org/wiki/T_', page_id, '/x')
 when 8 then concat('https://stackoverflow.com/questions/', page_id, '/x') when 9 then concat('https://stackoverflow.com/questions/tagged/', page_id) when 10 then concat('https://arxiv.org/pdf/', page_id, '.1.pdf')
 when 11 then concat('https://youtu.be/v', page_id) when 12 then concat('https://www.youtube.com/watch?t=1&v=v', page_id) when 13 then concat('https://youtube.com/shorts/s', page_id)
 when 14 then concat('how to join ', page_id) when 15 then concat('https://github.com/o/r', page_id, '/issues/new') when 16 then 'ftp://e.com/x' else url end"""
ROUTED = f"""with i as (select page_id, {INPUT} as input from pages),
h as (select *, lower(regexp_extract(input, '^https?://([^/?#]*)', 1)) as host, regexp_extract(input, '^https?://[^/?#]*([^?#]*)', 1) as path, regexp_extract(input, '[?]([^#]*)', 1) as pairs from i),
g as (select *, list_filter(string_split(path, '/'), lambda x: x <> '') as segs from h),
m as (select *, case when not regexp_matches(input, '^https?://[^/?#]+') then null
  when host = 'github.com' and len(segs) >= 2 then ['github', segs[1] || '/' || segs[2]]
  when host in ('reddit.com', 'www.reddit.com', 'old.reddit.com') then ['reddit', input]
  when host = 'news.ycombinator.com' and regexp_matches(pairs, '(^|&)id=') then ['hackernews', regexp_extract(pairs, '(^|&)id=([^&]*)', 2)]
  when host = 'en.wikipedia.org' and segs[1] = 'wiki' and len(segs) >= 2 then ['wikipedia', segs[2]]
  when host = 'stackoverflow.com' and segs[1] = 'questions' and regexp_full_match(segs[2], '[0-9]+') then ['stackoverflow', segs[2]]
  when host = 'arxiv.org' and segs[1] in ('abs', 'pdf') and len(segs) >= 2 then ['arxiv', regexp_replace(segs[2], '\\.pdf$', '')]
  when host = 'youtu.be' and len(segs) >= 1 then ['youtube', segs[1]]
  when host in ('youtube.com', 'www.youtube.com') and regexp_matches(pairs, '(^|&)v=') then ['youtube', regexp_extract(pairs, '(^|&)v=([^&]*)', 2)]
  when host in ('youtube.com', 'www.youtube.com') and segs[1] in ('shorts', 'embed', 'v') and len(segs) >= 2 then ['youtube', segs[2]]
  else ['generic', null] end as found from g),
r as (select *, found[1] as platform, found[2] as item, case when segs[3] in ('issues', 'pulls') then case when regexp_full_match(segs[4], '[0-9]+') then '/issues/' || segs[4] else '/issues' end else '' end as hub from m)
"""


def _inputs(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.expr(INPUT).alias("input"))


@query(ROUTED + """select page_id, input, case when platform is null then 'query' else 'url' end as kind, coalesce(platform, 'search') as source_type,
 case platform when 'github' then 'https://github.com/' || item || hub when 'hackernews' then 'https://news.ycombinator.com/item?id=' || item when 'wikipedia' then 'https://en.wikipedia.org/wiki/' || item
  when 'stackoverflow' then 'https://stackoverflow.com/questions/' || item when 'arxiv' then 'https://arxiv.org/abs/' || item when 'youtube' then input when 'reddit' then input when 'generic' then input end as url,
 case when platform is null then input end as query,
 case platform when 'github' then 'github.com' when 'reddit' then 'reddit.com' when 'hackernews' then host when 'wikipedia' then 'wikipedia.org' when 'stackoverflow' then host when 'arxiv' then host when 'youtube' then 'youtube.com' when 'generic' then host end as domain
 from r""")
def url_route(spark, sf_dir):
    return cascade.dispatched(_inputs(spark, sf_dir))


@query("""with i as (select page_id, case when page_id % 3 = 0 then url else regexp_replace(url, '^https?://', '') end as input from pages)
select page_id, case when input like 'http%' then input else 'https://' || input end as url, lower(regexp_extract(input, '^(?:https?://)?([^/?#]*)', 1)) as domain, input as query from i""")
def url_forced(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.regexp_replace("url", "^https?://", "")).alias("input"))
    asked = cascade.dispatched(rows, force_query=True).select(F.col("page_id").alias("_id"), F.col("query").alias("_query"))
    found = cascade.dispatched(rows, force_url=True).join(asked, F.col("page_id") == F.col("_id"))
    return found.select("page_id", "url", "domain", F.col("_query").alias("query"))


@query(ROUTED + """select page_id, platform, item, case when platform = 'github' then case hub when '' then 'readme' when '/issues' then 'issues' else 'issue' end end as hub_kind,
 case when platform = 'github' and hub like '/issues/%' then cast(segs[4] as bigint) end as issue,
 case platform when 'reddit' then rtrim(regexp_replace(item, '[?#].*$', ''), '/') || '?' || pairs || '.json' when 'hackernews' then 'https://hn.algolia.com/api/v1/items/' || item
  when 'wikipedia' then 'https://en.wikipedia.org/api/rest_v1/page/summary/' || item when 'stackoverflow' then 'https://api.stackexchange.com/2.3/questions/' || item || '/answers?order=desc&sort=votes&site=stackoverflow&filter=withbody'
  when 'arxiv' then 'https://export.arxiv.org/api/query?id_list=' || item || '&max_results=1' when 'youtube' then 'https://www.youtube.com/oembed?url=' || item || '&format=json' end as data_url
 from r where platform is not null""")
def url_platform_items(spark, sf_dir):
    rows = _inputs(spark, sf_dir).where(urls.route(F.col("input")) == "url")
    kind, item = urls.platform(F.col("input")), urls.platform_item(F.col("input"))
    rows = rows.withColumn("platform", kind).withColumn("item", F.coalesce(*[F.when(F.col("platform") == k, c) for k, c in item.items()]))
    hub = urls.github_parts(F.col("input"))
    is_hub = F.col("platform") == "github"
    return rows.select("page_id", "platform", "item", F.when(is_hub, hub["kind"]).alias("hub_kind"), F.when(is_hub, hub["issue"]).alias("issue"), urls.api_url(F.col("platform"), F.col("item")).alias("data_url"))


@query("select item_id, 'https://api.openalex.org/works/W' || item_id as work_url, 'https://api.semanticscholar.org/graph/v1/paper/CorpusID:' || item_id as paper_url from benchmark")
def url_scholar(spark, sf_dir):
    made = [urls.api_url(F.lit(kind), F.concat(F.lit(mark), F.col("item_id").cast("string"))).alias(name) for kind, mark, name in (("openalex", "W", "work_url"), ("semantic_scholar", "CorpusID:", "paper_url"))]
    return read(spark, sf_dir, "benchmark").select("item_id", *made)


@query("select doc_id, regexp_replace(url_encode(text), '%20', '+', 'g') as encoded, text as decoded from (select doc_id, regexp_replace(substr(text, 1, 200), '[^A-Za-z0-9 éèüöäßñ&=+/?%#]', '', 'g') as text from documents)")
def url_codec(spark, sf_dir):
    text = F.regexp_replace(F.substring("text", 1, 200), "[^A-Za-z0-9 éèüöäßñ&=+/?%#]", "")
    rows = read(spark, sf_dir, "documents").select("doc_id", F.url_encode(text).alias("encoded"))
    return rows.select("doc_id", "encoded", F.try_url_decode("encoded").alias("decoded"))


HOSTS = """case doc_id % 8 when 0 then 'docs.rs' when 1 then 'www.amazon.com' when 2 then concat('p', doc_id, '.readthedocs.io') when 3 then 'x.gov' when 4 then 'www.reddit.com' when 5 then concat('h', doc_id, '.github.io') when 6 then 'en.wikipedia.org' else 'example.com' end"""


@query(f"""with h as (select doc_id, {HOSTS} as host from documents)
select doc_id, host, case regexp_replace(host, '^www\\.', '') {" ".join(f"when '{h}' then '{f}'" for h, f in V.FAMILY_HOSTS.items())} else case {" ".join(f"when host like '%{x}' then '{f}'" for x, f in V.FAMILY_SUFFIXES)} else 'generic' end end as family from h""")
def url_host_family(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.expr(HOSTS).alias("host"))
    return rows.withColumn("family", urls.family_of_host(F.col("host")))


@query(f"select page_id, {FAMILY_SQL} as family from pages")
def url_family_hint(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.family_hint(F.col("url")).alias("family"))


PROBED = """case page_id % 4 when 0 then concat('https://d', page_id, '.x/guide/start') when 1 then concat('https://d', page_id, '.x/guide/?v=1') when 2 then concat('https://d', page_id, '.x/a/readme.md') else url end"""
ORIGIN = "regexp_extract(u, '^(https?://[^/?#]*)', 1)"


@query(f"""with p as (select page_id, {PROBED} as u from pages), q as (select page_id, u, {ORIGIN} as o, coalesce(nullif({PATH.replace("url", "u")}, ''), '/') as path, {QUERY.replace("url", "u")} as q from p)
select page_id, unnest(['md', 'folder', 'full', 'llms', 'known']) as probe, unnest([case when not regexp_matches(path, '(/|[.]md|[.]html)$') then o || path || '.md' || q end,
 case when path like '%/' or not contains(path, '.') then o || regexp_replace(path, '[^/]*$', '') || 'index.html.md' end, o || '/llms-full.txt', o || '/llms.txt', o || '/.well-known/llms.txt']) as at from q""")
def url_probe_candidates(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", F.expr(PROBED).alias("u"))
    names = F.array(*[F.lit(x) for x in ("md", "folder", "full", "llms", "known")])
    return rows.select("page_id", F.explode(F.arrays_zip(names.alias("probe"), urls.probe_urls(F.col("u")).alias("at"))).alias("x")).select("page_id", "x.probe", "x.at")


HREFS = """case page_id % 9 when 0 then concat('a', page_id, '/b/#f') when 1 then '../up/./x' when 2 then '/root/' when 3 then concat('//d', page_id % 7, '.x/p?q=1') when 4 then 'mailto:a@b.c' when 5 then '#top' when 6 then '?page=2' when 7 then '../../..' else 'https://other.x/' end"""


@query(f"""with l as (select page_id, concat('https://d', page_id % 7, '.x') as o, {HREFS} as href from pages),
w as (select page_id, o, href, case when href like 'https://%' then href when href like '//%' then 'https:' || href when href like 'mailto:%' then null when href like '/%' then o || href
 when href like '#%' then o || '/x/y/z' when href like '?%' then o || '/x/y/z' || href when href = '../../..' then o || '/' when href like '../%' then o || '/x/up/x' else o || '/x/y/' || href end as u from l)
select page_id, href, case when u like o || '/%' then case when regexp_replace(u, '#.*$', '') = o || '/' then o || '/' else regexp_replace(regexp_replace(u, '#.*$', ''), '/+$', '') end end as target from w""")
def url_resolve_links(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://d"), (F.col("page_id") % 7).cast("string"), F.lit(".x/x/y/z")).alias("base"), F.expr(HREFS).alias("href"))
    return rows.select("page_id", "href", urls.resolve(F.col("base"), F.col("href")).alias("target"))


STATUS = "case event_id % 11 when 0 then 429 when 1 then 403 when 2 then 500 when 3 then 502 when 4 then 503 when 5 then 504 when 6 then 404 when 7 then 301 else 200 end"


@query(f"""with s as (select event_id, {STATUS} as status from events)
select event_id, status, status in (429, 500, 502, 503, 504) as retryable, case when status in (403, 429) then 'Blocked' when status not between 200 and 299 then 'Network' end as error,
 case when status in (403, 429) then 3 when status not between 200 and 299 then 2 else 0 end as exit_code from s""")
def exit_code_map(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.expr(STATUS).alias("status"))
    rows = rows.withColumn("retryable", urls.is_retryable(F.col("status"))).withColumn("error", urls.fetch_error(F.col("status")))
    return rows.withColumn("exit_code", urls.exit_code(F.col("error")))


PROBE_TYPES = "case page_id % 5 when 0 then 'text/markdown' when 1 then 'text/html; charset=utf-8' when 2 then 'text/x-html-markdown' when 3 then 'TEXT/HTML' end"


@query(f"""with t as (select page_id, {PROBE_TYPES} as ct, case when page_id % 7 = 0 then '  ' else url end as body, case when page_id % 6 = 0 then 404 else 200 end as status from pages)
select page_id, status = 200 and not (contains(lower(coalesce(ct, '')), 'html') and not contains(lower(coalesce(ct, '')), 'markdown')) and trim(body) <> '' as accepted from t""")
def probe_accept(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", "url", F.expr(PROBE_TYPES).alias("ct"))
    body, status = F.when(F.col("page_id") % 7 == 0, "  ").otherwise(F.col("url")), F.when(F.col("page_id") % 6 == 0, 404).otherwise(200)
    return rows.select("page_id", adapters.probe_accepts(status, F.col("ct"), body).alias("accepted"))


@query("""with t as (select page_id, case page_id % 5 when 0 then 'text/html; charset=utf-8' when 1 then 'application/json' when 2 then 'image/png' when 3 then null else 'application/xhtml+xml' end as ct, strlen(html) as n from pages)
select page_id, case when ct is null then 'missing_type' when not (split_part(ct, ';', 1) like 'text/%' or split_part(ct, ';', 1) in ('application/json', 'application/xml', 'application/xhtml+xml')) then 'bad_type' when n > 5242880 then 'too_large' else 'ok' end as reason from t""")
def preflight_gate(spark, sf_dir):
    kind = F.pmod("page_id", F.lit(5))
    ct = F.when(kind == 0, "text/html; charset=utf-8").when(kind == 1, "application/json").when(kind == 2, "image/png").when(kind == 4, "application/xhtml+xml")
    return read(spark, sf_dir, "pages").select("page_id", adapters.preflight(ct, F.octet_length("html")).alias("reason"))


@query(f"select {AUTH} as host, count(*) as n from pages group by 1 order by n desc, host limit 20")
def domain_frequency_topn(spark, sf_dir):
    return read(spark, sf_dir, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(20)


@query(f"select page_id, {AUTH} as host, cast(ceil(row_number() over (partition by {AUTH} order by page_id) / 3.0) as bigint) as wave from pages")
def host_wave_schedule(spark, sf_dir):
    return crawl.host_waves(read(spark, sf_dir, "pages"), part_bits=4).select("page_id", "host", "wave")
