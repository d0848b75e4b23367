"""From an input to its text: routing, cached bodies, the cascade of sources for a page, archived pages, batches, log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions import values as V
from ..sources import adapters
from . import candidates, find, formats, platforms


def dispatched(inputs: DataFrame, force_url: bool = False, force_query: bool = False, site: str | None = None) -> DataFrame:
    """inputs(input) with what they lead to: kind (url or query), url, query, source_type and domain."""
    text = F.col("input")
    whole = F.when(~text.rlike("^https?://"), F.concat(F.lit("https://"), text)).otherwise(text) if force_url else text
    kind = F.lit("query") if force_query else urls.route(whole)
    at = urls.source_of(whole)
    is_url = F.col("kind") == "url"
    rows = inputs.withColumn("kind", kind).withColumn("_at", F.when(is_url, at))
    rows = rows.withColumn("url", F.col("_at.url")).withColumn("query", F.when(~is_url, whole)).withColumn("source_type", F.coalesce("_at.source_type", F.lit("search")))
    return rows.withColumn("domain", F.when(is_url, F.col("_at.domain")).otherwise(F.lit(site).cast("string"))).drop("_at")


def platform_text(kind: Column, payload: Column, density: int) -> Column:
    """The Markdown of a platform's payload; null for kinds that have more than one payload, and for others."""
    r, h, a = adapters.reddit(payload), adapters.hacker_news(payload), adapters.arxiv(payload)
    made = {
        "reddit": platforms.reddit(r["title"], r["selftext"], r["comments"], density),
        "hackernews": platforms.hacker_news(h["title"], h["text"], h["comments"], density),
        "wikipedia": adapters.wikipedia(payload, density),
        "arxiv": platforms.paper(a["title"], a["authors"], a["published"], a["abstract"], a["id"], density),
    }
    return F.coalesce(*[F.when(kind == k, c) for k, c in made.items()])


def with_cached(requests: DataFrame, stored: DataFrame, ttl_seconds: int) -> DataFrame:
    """requests(url, at) with body and cache_hit: the newest body of stored(key, body, stored_at) under the URL's key that is no older than the TTL."""
    latest = stored.groupBy("key").agg(F.max(F.struct("stored_at", "body")).alias("s")).select(F.col("key").alias("_key"), "s.*")
    rows = requests.join(latest, urls.cache_key(F.col("url")) == F.col("_key"), "left")
    hit = F.coalesce(F.unix_micros("at") - F.unix_micros("stored_at") <= ttl_seconds * 1_000_000, F.lit(False))
    return rows.withColumn("cache_hit", hit).withColumn("body", F.when(hit, F.col("body"))).drop("_key", "stored_at")


def generic_text(wanted: DataFrame, bodies: DataFrame, crawled: DataFrame, density: int = 2, allow_cloud: bool = False) -> DataFrame:
    """(url, source, text, n_pages, sparse) for wanted(url): the first source that has something.

    Sources are the cloud reader where allowed, the page's Markdown twins, the site's llms.txt, then the crawl; a crawl of one page that says
    too little gives way to the cloud reader where that is allowed, else it is marked sparse.  bodies is (url, status, content_type, body), the
    cloud reader's under its own prefix; crawled is (url, text, n_pages).  source is null where no source has anything."""
    probes = urls.probe_urls(F.col("url"))
    tried = [("markdown", 1, F.get(probes, 0)), ("markdown", 2, F.get(probes, 1)), ("llms", 3, F.get(probes, 3)), ("llms", 4, F.get(probes, 4))]
    if allow_cloud:
        tried.insert(0, ("cloud", 0, F.concat(F.lit(V.CLOUD_READER), F.col("url"))))
    asked = wanted.select("url", F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(n).alias("place"), u.alias("at")) for s, n, u in tried])).alias("t")).select("url", "t.*").where("at is not null")
    accepted = bodies.where(adapters.probe_accepts(F.col("status"), F.col("content_type"), F.col("body"))).select(F.col("url").alias("_at"), "body")
    best = asked.join(accepted, F.col("at") == F.col("_at")).groupBy(F.col("url").alias("_url")).agg(F.min(F.struct("place", "source", "body")).alias("b"))
    pages = crawled.select(F.col("url").alias("_page"), F.col("text").alias("_text"), F.col("n_pages").alias("_n"))
    rows = wanted.select("url").join(best, F.col("url") == F.col("_url"), "left").join(pages, F.col("url") == F.col("_page"), "left")
    source = F.coalesce("b.source", F.when(F.col("_text").isNotNull(), "crawl"))
    body = F.coalesce("b.body", "_text")
    shown = formats.tier(F.col("url"), body, density)
    shown = F.when(source == "cloud", F.concat(F.lit(V.CLOUD_NOTE), shown)).otherwise(shown)
    sparse = F.coalesce((source == "crawl") & candidates.is_sparse(F.col("_text"), F.col("_n")), F.lit(False))
    return rows.select("url", source.alias("source"), shown.alias("text"), F.when(source == "crawl", F.col("_n")).when(source.isNotNull(), 1).cast("bigint").alias("n_pages"), sparse.alias("sparse"))


def as_of(wanted: DataFrame, snapshots: DataFrame, form: str = "md") -> DataFrame:
    """wanted(url, date) with the text of the snapshot(url, ts, snapshot_url, text) nearest to noon of that date, and error.

    error is Config for a date that is none, NoContent for a page without snapshots, else null."""
    valid = adapters.valid_date(F.col("date"))
    noon = F.to_timestamp(F.concat(F.when(valid, F.col("date")), F.lit(" 12:00:00")))
    near = adapters.nearest_snapshots(
        wanted.where(valid).select(F.col("url").alias("key"), noon.alias("at")).distinct(), snapshots.select(F.col("url").alias("key"), "ts", F.col("snapshot_url").alias("id"))
    ).select(F.col("key").alias("_key"), F.col("at").alias("_at"), "nearest", "nearest_id")
    texts = snapshots.select(F.col("snapshot_url").alias("_id"), F.col("url").alias("_u"), F.col("ts").alias("_ts"), F.col("text").alias("_text"))
    rows = wanted.join(near, (F.col("url") == F.col("_key")) & (noon == F.col("_at")), "left")
    rows = rows.join(texts, (F.col("nearest_id") == F.col("_id")) & (F.col("url") == F.col("_u")) & (F.col("nearest") == F.col("_ts")), "left")
    day = F.date_format("nearest", "yyyy-MM-dd")
    text = F.concat(adapters.archived_prelude(F.col("date"), day, F.col("nearest_id"), form), F.col("_text"))
    error = F.when(~valid, "Config").when(F.col("nearest_id").isNull(), "NoContent")
    return rows.select("url", "date", F.col("nearest_id").alias("snapshot_url"), day.alias("snapshot_date"), text.alias("text"), error.alias("error"))


def batch_urls(lines: DataFrame, max_pages: int) -> DataFrame:
    """(place, url): lines(place, line) as URLs, https:// put before those without a scheme; blank and invalid ones go, the first max_pages stay."""
    raw = F.trim(F.regexp_replace("line", r"[\t\r]", " "))
    whole = F.when(raw.rlike("^https?://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    valid = (raw != "") & whole.rlike(r"^https?://[^\s/?#:@\[\]]+(?::[0-9]{1,5})?(?:[/?#]|$)")
    return lines.where(valid).select("place", whole.alias("url")).orderBy("place").limit(max_pages)


def batch_merge(done: DataFrame) -> DataFrame:
    """One row (n_ok, merged, error) of done(place, text): texts that are not blank joined by blank lines, in order; error NoContent without any."""
    ok = F.when(formats.stripped(F.col("text")) != "", F.struct("place", "text"))
    rows = done.agg(F.count(ok).alias("n_ok"), F.sort_array(F.collect_list(ok)).alias("xs"))
    merged = F.array_join(F.transform("xs", lambda x: x["text"]), "\n\n")
    return rows.select("n_ok", F.when(F.col("n_ok") > 0, merged).alias("merged"), F.when(F.col("n_ok") == 0, "NoContent").alias("error"))


def joined_pages(crawled: DataFrame) -> DataFrame:
    """(seed, text, n_pages): crawled pages (seed, ord, url, text) of each seed in order, each under a line with its source.

    A seed's pages are as many as its crawl was allowed."""
    part = F.concat(formats.delimiter(urls.strip_tracking(F.col("url"))), F.col("text"))
    rows = crawled.groupBy("seed").agg(F.sort_array(F.collect_list(F.struct("ord", part.alias("part")))).alias("xs"))
    return rows.select("seed", F.array_join(F.transform("xs", lambda x: x["part"]), "").alias("text"), F.size("xs").cast("bigint").alias("n_pages"))


def fan_out(lists: DataFrame, required: list[str], failed: DataFrame | None = None) -> DataFrame:
    """Ranked lists without engines that failed for a query: failed is (query_id, engine).  A query whose required engine failed has no rows."""
    if failed is None:
        return lists
    gone = failed.select(F.col("query_id").alias("_q"), F.col("engine").alias("_e"))
    rows = lists.join(gone, (F.col("query_id") == F.col("_q")) & (F.col("engine") == F.col("_e")), "left_anti")
    broken = failed.where(F.col("engine").isin(required)).select(F.col("query_id").alias("_b")).distinct()
    return rows.join(broken, F.col("query_id") == F.col("_b"), "left_anti")


def search_errors(queries: DataFrame, lists: DataFrame, engines: list[str], failed: DataFrame) -> DataFrame:
    """(query_id, error) of each query: blank ones, and those for which every engine failed or found nothing; null for others."""
    asked = queries.select("query_id", "query", F.explode(F.array(*[F.lit(e) for e in engines])).alias("engine"))
    found = lists.select("query_id", "engine").distinct().withColumn("_found", F.lit(True))
    said = failed.select("query_id", "engine", F.col("error").alias("_error"))
    rows = asked.join(found, ["query_id", "engine"], "left").join(said, ["query_id", "engine"], "left")
    why = F.when(F.col("_error").isNotNull(), F.concat("engine", F.lit(": "), "_error")).when(F.col("_found").isNull(), F.concat("engine", F.lit(": no results")))
    place = F.array_position(F.array(*[F.lit(e) for e in engines]), F.col("engine"))
    per = rows.groupBy("query_id").agg(F.first("query").alias("query"), F.count(why).alias("n"), F.sort_array(F.collect_list(F.when(why.isNotNull(), F.struct(place.alias("p"), why.alias("w"))))).alias("xs"))
    every = F.concat(F.lit("all search engines failed or returned no results ("), F.array_join(F.transform("xs", lambda x: x["w"]), "; "), F.lit(")"))
    return per.select("query_id", F.when(F.trim("query") == "", "query is empty").when(F.col("n") == len(engines), every).alias("error"))


MODES = {1: "compact", 2: "standard", 3: "full"}


def session_entries(done: DataFrame, terms: list[str], density: int, **flags) -> DataFrame:
    """Log rows of done(input, at, text, tokens, cache_hit, error); text is null where there was none."""
    rows = dispatched(done, **flags)
    wanted = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    low = F.translate(F.col("text"), find.UP, find.LOW)
    found = F.coalesce(F.filter(wanted, lambda t: F.contains(low, t)), F.array().cast("array<string>"))
    code = urls.exit_code(F.col("error"))
    return rows.select(
        F.unix_seconds("at").cast("string").alias("timestamp"), "url", "query", "source_type", "domain", F.col("tokens").cast("bigint").alias("tokens"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes"), "cache_hit", F.lit(MODES[density]).alias("mode"), found.alias("keywords_found"),
        F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("output_chars"), ((code == 0) & F.col("error").isNull()).alias("success"), code.cast("int").alias("exit_code"), "error",
    )


def first_come(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows without those whose keys came before."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
