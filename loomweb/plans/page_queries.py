"""Queries on pages: extraction, links, threads, families, character sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from ..functions import values as V
from ..operators import candidates, formats, html
from .base import AUTH, FAMILY_SQL, KEPT, PATH, SCHEME, TITLE, _made, _page, _worded, _worded_sql, query, read


@query(f"select page_id, {TITLE} as title from pages")
def page_title(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
#: The Markdown of an article whose paragraphs hold text alone, or open a bold run that only the article's end closes.
SPREAD = f"replace(replace(replace(replace(replace(replace(replace({ARTICLE}, '<h1>', '# '), '</h1>', chr(10) || chr(10)), '<p>', chr(10) || chr(10)), '</p>', chr(10) || chr(10)), '<b>', '**'), '<br>', ''), chr(9), ' ')"
SPACED = f"regexp_replace(regexp_replace(regexp_replace({SPREAD}, ' +', ' ', 'g'), '([(\\[{{{{]) ', '\\1', 'g'), ' ([,.;:!?)\\]}}}}])', '\\1', 'g')"
CLOSED = f"regexp_replace(regexp_replace({SPACED.replace('{{', '{').replace('}}', '}')}, ' *\\n *', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') || repeat('**', len(string_split({ARTICLE}, '<b>')) - 1)"
MARKDOWN = f"replace(replace(regexp_replace({CLOSED}, '\\n{{3,}}', chr(1), 'g'), chr(10) || chr(10), chr(10)), chr(1), chr(10) || chr(10))"
CLEAN_URL = f"{SCHEME} || '://' || {AUTH} || case when {PATH} = '' then '/' else {PATH} end || {KEPT}"


def _extracted(spark, sf_dir, **how) -> DataFrame:
    return candidates.best_candidates(html.page_parts(read(spark, sf_dir, "pages")), **how)


@query(f"""with m as (select page_id, url, {MARKDOWN} as text from pages) select page_id, 'ok' as status, coalesce({FAMILY_SQL}, 'search') as family, 'article' as tag,
 '# --- [Source: ' || {CLEAN_URL} || '] ---' || chr(10) || chr(10) || substr(text, 1, 2000) || case when length(text) > 2000 then '... (truncated)' else '' end as markdown, sha256(text) as whole from m""")
def page_extract_markdown(spark, sf_dir):
    found = _extracted(spark, sf_dir)
    return found.select("page_id", "status", "family", "tag", formats.tier(F.col("url"), F.col("text"), 2).alias("markdown"), F.sha2("text", 256).alias("whole"))


@query(f"""select page_id, len(list_filter(regexp_split_to_array(regexp_replace({ARTICLE}, '(?s)<[^>]*>', ' ', 'g'), '\\s+'), lambda w: w <> '' and not regexp_full_match(w, '[*#.,;:!?]+'))) as words from pages""")
def page_best_candidate(spark, sf_dir):
    words = F.filter(T.words(F.regexp_replace("text", r"\*\*", "")), lambda w: ~w.rlike("^[*#.,;:!?]+$"))
    return _extracted(spark, sf_dir, tables=True).select("page_id", F.size(words).alias("words"))


NAV = "regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href=\"([^\"]+)\"', 1)"


@query(f"""with n as (select page_id, {AUTH} as host, {SCHEME} as scheme, {NAV} as hrefs from pages), f as (select page_id, scheme || '://' || host as o, list_distinct(hrefs) as kinds, hrefs from n),
x as (select page_id, o, unnest(kinds) as href, hrefs from f)
select page_id, row_number() over (partition by page_id order by list_position(hrefs, href)) - 1 as link_ord, href, o || case when rtrim(regexp_replace(href, '[#].*$', ''), '/') = '' then '/' else rtrim(regexp_replace(href, '[#].*$', ''), '/') end as target from x""")
def page_links(spark, sf_dir):
    shown = F.replace(F.replace("html", F.lit("<nav>"), F.lit("<main>")), F.lit("</nav>"), F.lit("</main>"))
    found = html.page_parts(read(spark, sf_dir, "pages").withColumn("html", shown)).select("page_id", "url", F.posexplode("links").alias("link_ord", "href"))
    return found.select("page_id", F.col("link_ord").cast("bigint").alias("link_ord"), "href", urls.resolve(F.col("url"), F.col("href")).alias("target"))


RENDERED = (
    "<html><body><main><h2>{w0} <i>{w1}</i></h2><p>{w2} <b>{w3}</b> , ( <em>{w4}</em> ) <code> {w5}  x </code></p><ul><li>{w6}<ul><li>{w7}</li></ul></li><li> </li><li>{w8}</li></ul><ol><li></li><li>{w9}</li><li>{w10}</li></ol>"
    "<pre><code class='a language-py'>\n{w0} = 1\n  {w1}\n</code></pre><blockquote><p>{w2}</p><p>{w3}</p></blockquote><table><thead><tr><th>{w4}</th><td></td><td>{w5}</td></tr></thead><tr><td>{w6}</td></tr><tr></tr></table>"
    "<hr><img alt=' {w7}  pic '><a href='https://E.com/?utm_source=x&id=1#f'>{w8}</a> <a href='/r'></a><nav>{w9}</nav><div class='sidebar'>{w10}</div><script>{w1}</script></main></body></html>"
)
EXPECTED = (
    "## {w0} *{w1}*\n\n{w2} **{w3}**, (*{w4}*) `{w5} x`\n\n- {w6}\n  - {w7}\n- {w8}\n\n1. {w9}\n2. {w10}\n\n```py\n{w0} = 1\n  {w1}\n```\n\n> {w2}\n>\n> {w3}\n\n| {w4} | {w5} |\n| {w6} |\n\n---\n[Image: {w7} pic] [{w8}](https://e.com/?id=1) [/r](/r)"
)


@query(_worded_sql(11) + f"select doc_id, {_made(EXPECTED)} as made from t")
def page_render(spark, sf_dir):
    pages = _worded(spark, sf_dir, 11).select(F.col("doc_id").alias("page_id"), F.lit("https://e.com/x").alias("url"), _page(RENDERED).alias("html"))
    return candidates.best_candidates(html.page_parts(pages)).select(F.col("page_id").alias("doc_id"), F.col("text").alias("made"))


#: A block of links with rows of text: kept as a listing from three paragraphs and four short lines on, or with a table, or below 30 bytes.
LINKED = """case doc_id % 4 when 0 then concat('<a href=/a>', w0, ' and more words that make a long label of a link</a> ', w1)
 when 1 then concat('<p>', w0, '</p><p>', w1, '</p><p>', w2, '</p><p>', w3, '</p><a href=/b>', w4, ' with a long label that outweighs all of the short paragraphs here</a>')
 when 2 then concat('<a href=/c>', w0, ' and more words that make a long label of a link</a><table><tr><td>', w1, '</td></tr></table>') else concat('<a href=/d>d</a>', substr(w0, 1, 3)) end"""
LABEL = " and more words that make a long label of a link"


@query(_worded_sql(5) + f"""select doc_id, case doc_id % 4 when 0 then w4 when 1 then w0 || chr(10) || chr(10) || w1 || chr(10) || chr(10) || w2 || chr(10) || chr(10) || w3 || chr(10) || '[' || w4 || ' with a long label that outweighs all of the short paragraphs here](/b) ' || w4
 when 2 then '[' || w0 || '{LABEL}](/c)' || chr(10) || '| ' || w1 || ' |' || chr(10) || w4 else '[d](/d) ' || substr(w0, 1, 3) || ' ' || w4 end as made from t""")
def page_link_saturation(spark, sf_dir):
    body = F.concat(F.lit("<main><div>"), F.expr(LINKED), F.lit("</div>"), F.col("w4"), F.lit("</main>"))
    pages = _worded(spark, sf_dir, 5).select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), body.alias("html"))
    return candidates.best_candidates(html.page_parts(pages)).select(F.col("page_id").alias("doc_id"), F.col("text").alias("made"))


#: Conversations as threads: each turn is a post with a score, every third one accepted.
@query("""with p as (select conv_id, turn, regexp_replace(substr(text, 1, 60), '[^A-Za-z ]', '', 'g') as raw, (length(text) % 13) - 4 as score, turn % 3 = 2 as ok from conversations),
c as (select conv_id, turn, trim(regexp_replace(raw, ' +', ' ', 'g')) as body, score, ok from p), f as (select * from c where body <> ''),
o as (select *, row_number() over (partition by conv_id order by turn) as n from f), r as (select *, row_number() over (partition by conv_id order by n > 1, not ok, -score, n) as place from o),
first as (select conv_id, body from o where n = 1)
select conv_id, any_value(first.body) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Answers' || chr(10) || chr(10) || coalesce(string_agg('### [Score: ' || score || ']' || case when ok then ' (Accepted Answer)' else '' end || chr(10) || chr(10) || r.body || chr(10) || chr(10), '' order by place) filter (n > 1), '') as thread
 from r join first using (conv_id) group by conv_id""")
def page_forum_thread(spark, sf_dir):
    body = F.regexp_replace(F.substring("text", 1, 60), "[^A-Za-z ]", "")
    post = F.concat(F.lit("<div class='post"), F.when(F.col("turn") % 3 == 2, " accepted").otherwise(""), F.lit("'><span class=score>"), (F.length("text") % 13 - 4).cast("string"), F.lit(" points</span>"), body, F.lit("</div>"))
    threads = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", post.alias("post")))).alias("xs"))
    pages = threads.select(F.col("conv_id").alias("page_id"), F.lit("https://x.com/forum/1").alias("url"), F.array_join(F.transform("xs", lambda x: x["post"]), "\n").alias("html"))
    rows = candidates.best_candidates(html.page_parts(pages)).where(F.col("text").contains("## Answers"))
    return rows.select(F.col("page_id").alias("conv_id"), F.col("text").alias("thread"))


@query(_worded_sql(8) + """select doc_id, 'a ' || w0 || ' ' || w1 || ' sentence of this page' || chr(10) || 'more ' || w2 || ' words in the list here' || chr(10) || 'last ' || w3 || ' part of the state ' || w4 as state from t""")
def page_embedded_state(spark, sf_dir):
    w = lambda *xs: F.concat(*[F.col(x[1:]) if x.startswith("$") else F.lit(x) for x in xs])
    value = F.struct(
        w("last ", "$w3", " part of the state ", "$w4").alias("z"), F.array(w("more ", "$w2", " words in the list here"), F.lit("short"), F.lit("onelongwordwithoutanyspacesinside")).alias("m"),
        F.struct(w("a ", "$w0", " ", "$w1", " sentence of this page").alias("b")).alias("a"),
    )
    shell = F.concat(F.lit('<html><body><div id="root">'), F.col("w5"), F.lit('</div><script id="__NEXT_DATA__" type="application/json">'), F.to_json(value), F.lit("</script></body></html>"))
    pages = _worded(spark, sf_dir, 8).select(F.col("doc_id").alias("page_id"), F.lit("https://e.com/x").alias("url"), shell.alias("html"))
    return candidates.best_candidates(html.page_parts(pages)).select(F.col("page_id").alias("doc_id"), F.col("text").alias("state"))


META = """case doc_id % 9 when 0 then '<meta property="og:type" content="article">' when 1 then '<meta property="og:type" content="product">' when 2 then '<meta property="og:type" content="website"><div itemtype="https://schema.org/BlogPosting"></div>'
 when 3 then '<div itemscope itemtype="https://schema.org/Product"></div>' when 4 then '<body itemtype="https://schema.org/SearchResultsPage"></body>' when 5 then '<ul itemtype="https://schema.org/ItemList"></ul>'
 when 6 then '<form><input type="search"></form><div class="hits"></div>' else '' end"""


@query(f"""with t as (select doc_id, case when doc_id % 5 = 0 then 'docs' end as hint, case doc_id % 9 when 0 then 'article' when 1 then 'product' when 2 then 'article' when 3 then 'product' when 4 then 'search' when 5 then 'listing' end as own, doc_id % 9 = 6 as form from documents)
select doc_id, coalesce(hint, own, 'search') as family, coalesce(hint, own, case when form then 'search' else 'generic' end) as intended from t""")
def page_family(spark, sf_dir):
    url = F.when(F.col("doc_id") % 5 == 0, "https://e.com/docs/x").otherwise("https://e.com/x")
    parts = html.page_parts(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), url.alias("url"), F.expr(META).alias("html")))
    own = lambda compat: candidates.page_family(F.col("url"), F.col("og_type"), F.col("item_type"), F.col("is_search"), compat)
    return parts.select(F.col("page_id").alias("doc_id"), own(True).alias("family"), own(False).alias("intended"))


#: Divisions that tell a family by name or by what they hold.
BLOCK = """case doc_id % 6 when 0 then concat('<main class="api-box"><p>', w0, '</p></main>') when 1 then concat('<main><h2>', w0, '</h2><p>costs $5</p></main>') when 2 then concat('<main id="storytime"><p>', w0, '</p></main>')
 when 3 then concat('<main><pre>', w0, '</pre></main>') when 4 then concat('<main class="x">', repeat(concat('<p>', repeat(concat(w0, ' ', w1, ' '), 40), '</p>'), 4), '</main>') else concat('<main><p>', w0, '</p></main>') end"""


@query("select doc_id, case doc_id % 6 when 0 then 'docs' when 1 then 'product' when 2 then 'article' when 3 then 'docs' when 4 then 'article' else 'generic' end as family from documents")
def page_candidate_family(spark, sf_dir):
    pages = _worded(spark, sf_dir, 2).select(F.col("doc_id").alias("page_id"), F.lit("https://e.com/x").alias("url"), F.expr(BLOCK).alias("html"))
    return candidates.scored_candidates(html.page_parts(pages), compat=False).select(F.col("page_id").alias("doc_id"), F.col("candidate_family").alias("family"))


@query("select page_id, case page_id % 4 when 1 then regexp_replace(html, '[^\\x{00}-\\x{FF}]', '?', 'g') else html end as html from pages")
def page_decode(spark, sf_dir):
    kind = F.col("page_id") % 4
    body = F.when(kind == 1, F.encode("html", "ISO-8859-1")).when(kind == 2, F.encode("html", "UTF-16BE")).when(kind == 3, F.concat(F.lit(b"\xef\xbb\xbf"), F.encode("html", "UTF-8"))).otherwise(F.encode("html", "UTF-8"))
    how = F.when(kind == 1, "text/html; charset=latin1").when(kind == 2, 'text/html; charset="UTF-16BE"').when(kind == 3, "text/html; charset=iso-8859-1").otherwise("text/html; charset=nonsense")
    return html.decoded(read(spark, sf_dir, "pages").select("page_id", body.alias("html"), how.alias("content_type")))


@query("select page_id, case page_id % 3 when 0 then 'ok' when 1 then 'empty' else 'too_large' end as status, case page_id % 3 when 0 then 'x' else '' end as text from pages")
def page_status(spark, sf_dir):
    kind = F.col("page_id") % 3
    body = F.when(kind == 0, F.concat(F.repeat(F.lit("<div><b>"), 400), F.lit("x<![foo "))).when(kind == 1, "<p> </p><![CDATA[x]]><!-- y").otherwise(F.repeat(F.lit("z"), V.MAX_PAGE_BYTES + 1))
    some = read(spark, sf_dir, "pages").select("page_id", "url", body.alias("html"))
    return candidates.best_candidates(html.page_parts(some)).select("page_id", "status", F.regexp_replace("text", r"\*", "").alias("text"))


@query(_worded_sql(6) + """, m as (select doc_id, '[' || w0 || '](/a) ' || w1 || chr(10) || '```' || chr(10) || w2 || chr(10) || '```' as md, '<body><main><a href=/a>' || w0 || '</a> ' || w1 || '<pre>' || w2 || '</pre></main>' || repeat('pad ', 30) || '<nav>' || w3 || '</nav></body>' as h from t)
select doc_id, round(strlen(md) / strlen(h)::double, 3) as compression, round(strlen(md) / strlen(regexp_replace(h, '<[^>]*>', '', 'g'))::double, 3) as noise_to_signal,
 round(strlen(regexp_extract(md, '^[^)]*[)]')) / strlen(md)::double, 3) as link_saturation, round(strlen(regexp_extract(md, '(?s)```.*```')) / strlen(md)::double, 3) as code_share from m""")
def page_quality_metrics(spark, sf_dir):
    made = _page("<body><main><a href=/a>{w0}</a> {w1}<pre>{w2}</pre></main>" + "pad " * 30 + "<nav>{w3}</nav></body>")
    pages = _worded(spark, sf_dir, 6).select(F.col("doc_id").alias("page_id"), F.lit("https://e.com/x").alias("url"), made.alias("html"))
    best = candidates.best_candidates(html.page_parts(pages)).withColumn("text", F.regexp_replace("text", " " + "pad ?" * 30 + "$", ""))
    rows = best.join(pages.select(F.col("page_id").alias("_id"), F.octet_length("html").alias("n")), F.col("page_id") == F.col("_id"))
    return rows.select(F.col("page_id").alias("doc_id"), *[c.alias(n) for n, c in candidates.quality_metrics(F.col("n"), F.col("body_bytes"), F.col("text")).items()])
