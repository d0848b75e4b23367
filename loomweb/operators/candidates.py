"""Scores of extraction candidates as integer columns, and the best one of each page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from ..functions import values as V


def base_score(s: dict[str, Column], tag: Column, depth: Column, hints: Column, tables: bool = False) -> Column:
    score = s["words"] + 24 * s["paragraphs"] + 18 * s["headings"] + 20 * s["code_fences"] + 10 * s["list_items"]
    ratio = F.when(s["bytes"] > 0, s["links"] * 30.0 / s["bytes"]).otherwise(0.0)
    score = score - F.when(ratio > 0.4, (score * F.least(ratio, F.lit(1.0))).cast("bigint")).otherwise(0)
    score = score - 4 * s["links"] - 2 * s["short_lines"] - 12 * F.greatest(depth - 3, F.lit(0))
    long = s["words"] > 150
    bonus = F.when(tag == "article", 80 + F.when(long, 40).otherwise(0)).when(tag == "main", 60 + F.when(long, 30).otherwise(0))
    bonus = bonus.when(tag == "section", 20).when(tag == "div", 10).when(tag == "table", 80 if tables else 12).when(tag == "body", -40).otherwise(0)
    said = lambda wanted: F.size(F.filter(F.array(*[F.lit(h) for h in wanted]), lambda h: F.contains(hints, h)))
    score = score + bonus + F.when(hints.contains("main-content") | hints.contains("primary-content"), 35).otherwise(0)
    return score + 24 * said(V.POSITIVE_HINTS) - 60 * said(V.NEGATIVE_HINTS)


def page_family(url: Column, og_type: Column, item_type: Column, is_search: Column, compat: bool = True) -> Column:
    """The family by URL, else by the page's own og:type, else by its first itemtype.

    Other pages count as search pages, as the results to match have it; without compat only those that look like one do, others are generic."""
    said = F.when(og_type.isin("article", "product"), og_type)
    has = lambda *names: reduce(lambda a, b: a | b, [item_type.contains(n) for n in names])
    schema = F.when(has("Article", "BlogPosting"), "article").when(has("Product"), "product").when(has("SearchResultsPage"), "search").when(has("ItemList"), "listing")
    return F.coalesce(urls.family_hint(url), said, schema, F.lit("search") if compat else F.when(is_search, "search").otherwise("generic"))


def candidate_family(family: Column, hints: Column, s: dict[str, Column], price: Column, spec: Column) -> Column:
    """The page's family; on a generic page that of the candidate's own id, class and counters."""
    said = lambda names: reduce(lambda a, b: a | b, [hints.contains(n) for n in names])
    code = (s["code_fences"] > 0) | ((s["headings"] >= 3) & (s["list_items"] >= 3) & (s["links"] >= 8))
    product = (price > 0) & ((spec > 0) | (s["list_items"] >= 2) | (s["headings"] >= 1))
    prose = (s["paragraphs"] >= 3) & (s["words"] >= 180)
    listing = (s["links"] >= 5) & (s["short_lines"] >= 8) & (s["paragraphs"] >= 3) & (s["links"] > s["words"] * 0.05)
    own = F.when(said(V.DOC_HINTS) | code, "docs").when(said(V.PRODUCT_HINTS) | product, "product").when(said(V.ARTICLE_HINTS) | prose, "article").when(listing, "listing").otherwise("generic")
    return F.when(family != "generic", family).otherwise(own)


def _scored(parts: DataFrame, tables: bool, compat: bool) -> DataFrame:
    """parts with the page's family and an array scored of its candidates that have words: score, place, tag, family, words, text.

    Candidates are scored inside their page's row, so no row moves.  Each step's fields are made once and read by the next one."""
    counters = ["words", "headings", "code_fences", "list_items", "short_lines", "links", "paragraphs", "bytes"]

    def counted(c: Column) -> Column:
        s = T.stats(c["text"])
        return F.struct(c["ord"].alias("ord"), c["depth"].alias("depth"), c["tag"].alias("tag"), c["hints"].alias("hints"), c["text"].alias("text"), T.price_lines(c["text"]).alias("price"), T.spec_lines(c["text"]).alias("spec"), *[s[n].alias(n) for n in counters])

    def named(c: Column) -> Column:
        own = candidate_family(F.col("family"), c["hints"], {n: c[n] for n in counters}, c["price"], c["spec"])
        return F.struct(c.alias("c"), own.alias("family"))

    def judged(x: Column) -> Column:
        c = x["c"]
        s = {n: c[n] for n in counters}
        extra = T.family_adjustment(s, c["price"], c["spec"])
        points = reduce(lambda other, f: F.when(x["family"] == f, extra[f]).otherwise(other), extra, F.lit(0))
        score = (base_score(s, c["tag"], c["depth"], c["hints"], tables) + points).cast("bigint")
        return F.struct(score.alias("score"), (-c["ord"]).alias("place"), c["tag"].alias("tag"), x["family"].alias("family"), c["words"].alias("words"), c["text"].alias("text"))

    rows = parts.withColumn("family", page_family(F.col("url"), F.col("og_type"), F.col("item_type"), F.col("is_search"), compat))
    told = F.filter(F.transform("candidates", counted), lambda c: c["words"] > 0)
    return rows.withColumn("scored", F.transform(F.transform(told, named), judged))


def scored_candidates(parts: DataFrame, tables: bool = False, compat: bool = True) -> DataFrame:
    """Each candidate of page_parts() with its tag, own family, words and score."""
    rows = _scored(parts, tables, compat).select("page_id", F.inline("scored"))
    return rows.select("page_id", (-F.col("place")).alias("ord"), "tag", F.col("family").alias("candidate_family"), "words", "score", "text")


def best_candidates(parts: DataFrame, tables: bool = False, compat: bool = True) -> DataFrame:
    """page_parts() with family, tag, score and text of each page, a row for every page.

    The candidate with the highest score is chosen, the first of equals.  Forum pages with posts are laid out as threads.  Embedded state
    stands for texts of under 100 words that it is longer than.  tag and score are null, and text is empty, where a page has no candidate."""
    rows = _scored(parts, tables, compat).withColumn("best", F.array_max("scored"))
    rows = rows.withColumn("text", F.when((F.col("family") == "forum") & (F.col("forum") != ""), F.col("forum")).otherwise(F.coalesce("best.text", F.lit(""))))
    words, found = T.word_count(F.col("text")), T.word_count(F.col("state"))
    text = F.when((words < 100) & (found > words), F.col("state")).otherwise(F.col("text"))
    return rows.select("page_id", "url", "status", "body_bytes", "family", "best.tag", "best.score", text.alias("text"))


def quality_metrics(html_bytes: Column, body_bytes: Column, text: Column) -> dict[str, Column]:
    """compression, noise_to_signal, link_saturation and code_share of an extracted text, rounded to 3 places."""
    size = F.octet_length(text)
    sum_of = lambda xs: F.aggregate(F.transform(xs, F.octet_length), F.lit(0), lambda a, b: a + b)
    share = lambda part, of: F.round(F.coalesce(F.try_divide(part, of), F.lit(0.0)), 3)
    links = F.regexp_extract_all(text, F.lit(r"\[[^\]]+\]\([^)]+\)"), F.lit(0))
    code = F.regexp_extract_all(text, F.lit(r"(?s)```.*?```"), F.lit(0))
    return {"compression": share(size, html_bytes), "noise_to_signal": share(size, body_bytes), "link_saturation": share(sum_of(links), size), "code_share": share(sum_of(code), size)}


def is_sparse(text: Column, n_pages: Column) -> Column:
    """Whether what was read says too little: one page of under 150 bytes."""
    return (F.octet_length(F.trim(text)) < 150) & (n_pages == 1)
