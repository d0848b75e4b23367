"""Structured payloads of search engines and platforms, parsed with explicit schemas into columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENGINE = "results array<struct<url:string,title:string,content:string,description:string>>"
REDDIT = "array<struct<data:struct<children:array<struct<kind:string,data:struct<title:string,selftext:string,body:string,score:bigint>>>>>>"
HN = "title string, text string, children array<struct<text:string>>"
ANSWERS = "items array<struct<body:string,score:bigint,is_accepted:boolean>>"
ISSUE = "number bigint, title string, body string, labels array<struct<name:string>>, user struct<login:string>"
WIKI = "title string, description string, extract string"
SPARQL = "head struct<vars:array<string>>, results struct<bindings:array<map<string,struct<value:string>>>>"
WAYBACK = "archived_snapshots struct<closest:struct<available:boolean,status:string,url:string,timestamp:string>>"
OEMBED = "title string, author_name string, author_url string"
REF = "question string, query string, prompt string, source_url string, sourceUrl string, url string, source string, answer string, reference_answer string, gold_answer string"


def engine_results(rows: DataFrame, payload: str, engine: str, engine_ord: int, snippet: str = "content", limit: int = 20) -> DataFrame:
    """(query_id, engine, engine_ord, rank, url, title, snippet) of a column of engine JSON; snippet is content or description."""
    found = rows.select("query_id", F.posexplode(F.slice(F.from_json(payload, ENGINE)["results"], 1, limit)).alias("rank", "r"))
    return found.select("query_id", F.lit(engine).alias("engine"), F.lit(engine_ord).alias("engine_ord"), F.col("rank").cast("bigint").alias("rank"), "r.url", "r.title", F.col(f"r.{snippet}").alias("snippet"))


def strip_tags(html: Column) -> Column:
    """Text of a comment: tags part words, white space is collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def answer_markdown(html: Column) -> Column:
    """Markdown of an answer's well-formed HTML: code, paragraphs, emphasis, links and list items; other tags go."""
    t = F.regexp_replace(html, r"(?is)<a\b[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>", "[$2]($1)")
    for tags, mark in (("pre", "\n```\n"), ("code", "`"), ("strong|b", "**"), ("em|i", "_")):
        t = F.regexp_replace(t, f"(?i)</?(?:{tags})(?:\\s[^>]*)?>", mark)
    t = F.regexp_replace(t, r"(?i)<(?:p|div|br)(?:\s[^>]*)?/?>", "\n\n")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<li(?:\s[^>]*)?>", "\n- "), "<[^>]*>", "")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def reddit(payload: Column) -> Column:
    """title, selftext and the comments of kind t1 with a positive score and a text."""
    listing = F.from_json(payload, REDDIT)
    post = F.get(F.get(listing, 0)["data"]["children"], 0)["data"]
    said = F.filter(F.get(listing, 1)["data"]["children"], lambda c: (c["kind"] == "t1") & (c["data"]["score"] > 0) & (F.trim(c["data"]["body"]) != ""))
    return F.struct(post["title"].alias("title"), F.coalesce(post["selftext"], F.lit("")).alias("selftext"), F.transform(said, lambda c: F.trim(c["data"]["body"])).alias("comments"))


def hacker_news(payload: Column) -> Column:
    item = F.from_json(payload, HN)
    texts = F.filter(F.transform(item["children"], lambda c: strip_tags(c["text"])), lambda t: t.isNotNull() & (t != ""))
    return F.struct(item["title"].alias("title"), F.nullif(strip_tags(item["text"]), F.lit("")).alias("text"), texts.alias("comments"))


def answers(payload: Column) -> Column:
    """Answers, accepted ones first, then by score, then as they came."""
    items = F.transform(F.from_json(payload, ANSWERS)["items"], lambda a, i: F.struct((~a["is_accepted"]).alias("o1"), (-a["score"]).alias("o2"), i.alias("o3"), answer_markdown(a["body"]).alias("body"), a["score"].alias("score"), a["is_accepted"].alias("is_accepted")))
    return F.transform(F.sort_array(items), lambda a: F.struct(a["body"].alias("body"), a["score"].alias("score"), a["is_accepted"].alias("is_accepted")))


def issue(payload: Column) -> Column:
    """(number, title, body, labels, author) of an issue."""
    i = F.from_json(payload, ISSUE)
    return F.struct(i["number"].alias("number"), i["title"].alias("title"), i["body"].alias("body"), F.transform(i["labels"], lambda x: x["name"]).alias("labels"), i["user"]["login"].alias("author"))


def with_comments(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """issues(key, ...) with their comments(key, place, login, body) as an array in order; none is an empty one.

    An issue's comments come together in a row, as they do in its page."""
    said = comments.groupBy(F.col("key").alias("_key")).agg(F.sort_array(F.collect_list(F.struct("place", "login", "body"))).alias("c"))
    rows = issues.join(said, F.col("key") == F.col("_key"), "left").drop("_key")
    none = F.array().cast("array<struct<login:string,body:string>>")
    return rows.withColumn("comments", F.coalesce(F.transform("c", lambda x: F.struct(x["login"].alias("login"), x["body"].alias("body"))), none)).drop("c")


def question_title(payload: Column) -> Column:
    return F.get(F.from_json(payload, "items array<struct<title:string>>")["items"], F.lit(0))["title"]


def with_answers(questions: DataFrame, replies: DataFrame) -> DataFrame:
    """questions(key, payload) and replies(key, payload) as (key, title, answers): a question without a reply page has no answers."""
    one = replies.select(F.col("key").alias("_key"), answers(F.col("payload")).alias("answers"))
    rows = questions.select("key", question_title(F.col("payload")).alias("title")).join(one, F.col("key") == F.col("_key"), "left").drop("_key")
    return rows.withColumn("answers", F.coalesce("answers", F.array().cast("array<struct<body:string,score:bigint,is_accepted:boolean>>")))


def wikipedia(payload: Column, density: int = 3) -> Column:
    """Title and description; from density 2 on the extract as well."""
    w = F.from_json(payload, WIKI)
    head = F.concat(F.lit("# "), w["title"], F.lit("\n\n"), F.coalesce(F.concat(F.lit("_"), w["description"], F.lit("_\n\n")), F.lit("")))
    return F.concat(head, w["extract"]) if density >= 2 else head


def arxiv(atom: Column) -> Column:
    """(title, authors, published, abstract, id) of a feed with one entry."""
    inner = lambda tag, n: F.trim(F.replace(F.try_element_at(F.regexp_extract_all(atom, F.lit(f"(?s)<{tag}[^>]*>(.*?)</{tag}>")), F.lit(n)), F.lit("\n"), F.lit(" ")))
    names = F.transform(F.regexp_extract_all(atom, F.lit("<name>([^<]*)</name>")), lambda x: F.trim(x))
    return F.struct(inner("title", 2).alias("title"), names.alias("authors"), F.substring(inner("published", 1), 1, 10).alias("published"), inner("summary", 1).alias("abstract"), inner("id", 2).alias("id"))


def xml_entities(text: Column) -> Column:
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def captions(xml: Column) -> Column:
    """Lines **[mm:ss]** text, with hours from one hour on; empty ones are left out."""
    pattern = r'(?s)<text [^>]*?start="([0-9]+)(?:\.[0-9]*)?"[^>]*>(.*?)</text>'
    starts, texts = F.regexp_extract_all(xml, F.lit(pattern), F.lit(1)), F.regexp_extract_all(xml, F.lit(pattern), F.lit(2))
    two = lambda n: F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))

    def line(x: Column) -> Column:
        s = x["s"].cast("bigint")
        h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
        at = F.concat(F.when(h > 0, F.concat(two(h), F.lit(":"))).otherwise(""), two(m), F.lit(":"), two(r))
        return F.concat(F.lit("**["), at, F.lit("]** "), x["t"])

    rows = F.transform(F.arrays_zip(starts.alias("s"), texts.alias("t")), lambda x: F.struct(x["s"].alias("s"), xml_entities(F.regexp_replace(x["t"], r"^\s+|\s+$", "")).alias("t")))
    return F.array_join(F.transform(F.filter(rows, lambda x: x["t"] != ""), line), "\n")


def oembed(payload: Column) -> Column:
    return F.from_json(payload, OEMBED)


def caption_url(page: Column) -> Column:
    """The first caption track's URL in a watch page; null if it has none."""
    found = F.regexp_extract(page, r'(?s)"captionTracks":.*?"baseUrl":"([^"]*)"', 1)
    return F.nullif(F.replace(found, F.lit("\\u0026"), F.lit("&")), F.lit(""))


def sparql_table(payload: Column) -> Column:
    """A Markdown table of all head variables; cells without a value are empty."""
    s = F.from_json(payload, SPARQL)
    names, rows = s["head"]["vars"], s["results"]["bindings"]
    cell = lambda v: F.trim(F.regexp_replace(F.replace(F.coalesce(v, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s+", " "))
    bar = lambda xs: F.concat(F.lit("| "), F.array_join(xs, " | "), F.lit(" |"))
    head = F.concat(bar(F.transform(names, cell)), F.lit("\n"), bar(F.transform(names, lambda v: F.lit("---"))), F.lit("\n"))
    body = F.transform(rows, lambda r: bar(F.transform(names, lambda v: cell(F.try_element_at(r, v)["value"]))))
    none = F.concat(bar(F.transform(names, lambda v, i: F.when(i == 0, "No rows returned").otherwise(""))), F.lit("\n"))
    table = F.concat(head, F.when(F.size(rows) == 0, none).otherwise(F.array_join(body, "\n")))
    return F.when(F.size(names) == 0, "| result |\n| --- |\n| No columns returned |").otherwise(table)


def wayback(payload: Column) -> Column:
    """(url, date) of the closest snapshot where it is there and its status is 2xx; else null."""
    c = F.from_json(payload, WAYBACK)["archived_snapshots"]["closest"]
    at = c["timestamp"]
    date = F.when(F.length(at) >= 8, F.concat(F.substring(at, 1, 4), F.lit("-"), F.substring(at, 5, 2), F.lit("-"), F.substring(at, 7, 2))).otherwise(at)
    return F.when(c["available"] & c["status"].startswith("2"), F.struct(c["url"].alias("url"), date.alias("date")))


def wayback_timestamp(date: Column) -> Column:
    """Noon of a valid date as the archive writes it; null for others."""
    return F.when(valid_date(date), F.concat(F.replace(date, F.lit("-"), F.lit("")), F.lit("120000")))


def archived_prelude(requested: Column, date: Column, url: Column, form: str = "md") -> Column:
    """The line before an archived page."""
    if form == "plain":
        parts = [F.lit("Archived snapshot requested "), requested, F.lit(" -> "), date, F.lit(" ("), url, F.lit(")\n\n")]
    else:
        parts = [F.lit("> **Archived snapshot** requested `"), requested, F.lit("` → `"), date, F.lit("` ([Wayback URL]("), url, F.lit("))\n\n")]
    return F.concat(*parts)


def valid_date(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def reference_question(rows: DataFrame) -> DataFrame:
    """(question, source_url, answer) of columns under any of their other names: the first that is not blank, trimmed."""
    def pick(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in rows.columns], F.lit(None).cast("string"))

    answer = F.coalesce(pick("answer", "reference_answer", "gold_answer"), F.lit(""))
    return rows.select(pick("question", "query", "prompt").alias("question"), pick("source_url", "sourceUrl", "url", "source").alias("source_url"), answer.alias("answer"))


def nearest_snapshots(wanted: DataFrame, snapshots: DataFrame) -> DataFrame:
    """wanted(key, at, ...) with the time and id of the nearest of snapshots(key, ts, id) as nearest and nearest_id; null without any.

    Of equally near ones it is the earlier, of equally early ones that with the smallest id.  Both sides are sorted once by key and time, and each
    wanted row looks at its neighbours, so no pairs are made.  Rows of a key are dealt to hours first, and each hour is told the last
    snapshot before and the first one after it, so a heavy key is spread over its hours."""
    names = wanted.columns
    hour = lambda t: F.floor(F.unix_micros(F.col(t)) / 3_600_000_000).cast("bigint")
    seen = snapshots.groupBy("key", "ts").agg(F.min("id").alias("id")).withColumn("hour", hour("ts"))
    asked = wanted.withColumn("hour", hour("at"))
    one = F.struct("ts", "id")
    # per key and hour: its first and last snapshot, and whether it is asked for
    hours = seen.groupBy("key", "hour").agg(F.min(one).alias("low"), F.max(one).alias("high"))
    hours = hours.unionByName(asked.select("key", "hour").distinct(), allowMissingColumns=True).groupBy("key", "hour").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    order = Window.partitionBy("key").orderBy("hour")
    earlier = F.last("high", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    later = F.first("low", True).over(order.rowsBetween(1, Window.unboundedFollowing))
    edges = hours.select("key", "hour", earlier.alias("_before"), later.alias("_after"))
    rows = asked.select("key", "hour", F.col("at").alias("_t"), F.struct(*names).alias("_row")).unionByName(seen.select("key", "hour", F.col("ts").alias("_t"), one.alias("_snap")), allowMissingColumns=True)
    near = Window.partitionBy("key", "hour").orderBy("_t")
    rows = rows.withColumn("_low", F.last("_snap", True).over(near.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("_high", F.first("_snap", True).over(near.rangeBetween(Window.currentRow, Window.unboundedFollowing))).where("_row is not null")
    rows = rows.join(edges, ["key", "hour"], "left")
    low, high = F.coalesce("_low", "_before"), F.coalesce("_high", "_after")
    gap = lambda s: F.abs(F.unix_micros(s["ts"]) - F.unix_micros(F.col("_t")))
    best = F.when(high.isNull() | (gap(low) <= gap(high)), low).otherwise(high)
    return rows.select("_row.*", best["ts"].alias("nearest"), best["id"].alias("nearest_id"))


def preflight(content_type: Column, size: Column) -> Column:
    """Why a body is not read: missing_type, bad_type or too_large; ok otherwise."""
    mime = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    text = mime.startswith("text/") | mime.isin("application/json", "application/xml", "application/xhtml+xml")
    return F.when(content_type.isNull(), "missing_type").when(~text, "bad_type").when(size > 5 * 1024 * 1024, "too_large").otherwise("ok")


def probe_accepts(status: Column, content_type: Column, body: Column) -> Column:
    """Whether a probe's response is Markdown or text: success, not HTML in disguise, not blank."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    html = kind.contains("html") & ~kind.contains("markdown")
    return F.coalesce(status.between(200, 299) & ~html & (F.regexp_replace(body, r"^\s+|\s+$", "") != ""), F.lit(False))
