"""Output shapes: density tiers, front matter, result pages, plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls

SNIPPET_CHARS = 2000


def delimiter(source: Column) -> Column:
    """Between pages of a crawl."""
    return F.concat(F.lit("\n\n# --- [Source: "), source, F.lit("] ---\n\n"))


def tier(source: Column, body: Column, density: int) -> Column:
    """A page under a line with its source. 1: a link; 2: the first characters; 3: all."""
    clean = urls.strip_tracking(source)
    if density == 1:
        body = F.concat(F.lit("- [Generic Page]("), clean, F.lit(")"))
    if density == 2:
        body = F.when(F.length(body) > SNIPPET_CHARS, F.concat(F.substring(body, 1, SNIPPET_CHARS), F.lit("... (truncated)"))).otherwise(body)
    return F.concat(F.lit("# --- [Source: "), clean, F.lit("] ---\n\n"), body)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def structured(source: Column, title: Column, kind: str, body: Column) -> Column:
    """A front-matter block; without a title the source stands for it, and the date is never known."""
    named = F.replace(F.coalesce(title, source), F.lit("\n"), F.lit(" "))
    return F.concat(F.lit("---\nsource: "), source, F.lit("\ntitle: "), named, F.lit(f"\ntype: {kind}\nfetched: unknown\n---\n\n"), stripped(body))


def plain(text: Column) -> Column:
    """Markdown without marks: headings, quotes, list items, emphasis, rules, comments and fences lose theirs, links show their target in brackets.

    Fenced lines stay as they are; blank lines do not follow each other."""

    def outside(t: Column) -> Column:
        t = F.regexp_replace(t, r"(?md)^[ \t\r]*(?:<!--[^\n]*|---[ \t\r]*)$\n?", "")
        t = F.regexp_replace(t, r"(?md)^[ \t\r]*# --- \[Source: ([^\n]*)\] ---[ \t\r]*$", "Source: $1\n")
        t = F.regexp_replace(F.regexp_replace(t, r"(?md)^#+[ \t]*", ""), r"(?md)^[ \t]+(?=#)", "")
        t = F.regexp_replace(t, r"(?md)^[ \t]*(?:> )+", "")
        t = F.regexp_replace(t, r"(?md)^[ \t]*[-*] ", "")
        t = F.regexp_replace(t, r"(?md)^[ \t]*[0-9]+\.[ \t]+", "")
        t = F.regexp_replace(t, r"\[([^\]\n]+)\]\(([^)\n]+)\)", "$1 ($2)")
        return F.regexp_replace(t, r"\*\*|__|`|(?md:[ \t\r]+$)", "")

    # a fence's first line goes whole, its last one leaves a blank line
    code = lambda t: F.regexp_replace(F.regexp_replace(t, r"\A[ \t\r]*```[^\n]*\n?", ""), r"(?md)^[ \t\r]*```[^\n]*\z", "")
    made = T.by_fences(text, outside, code)
    made = F.regexp_replace(made, r"\n([ \t\r]*)\n(?:[ \t\r]*\n)+", "\n$1\n")
    return stripped(made)


def result_text(title: Column, url: Column, snippet: Column, density: int) -> Column:
    """One search result as Markdown, with its line break."""
    link = F.concat(F.lit("["), title, F.lit("]("), url, F.lit(")\n"))
    if density == 1:
        return F.concat(F.lit("- "), link)
    if density == 2:
        return F.concat(F.lit("- "), link, F.coalesce(F.concat(F.lit("  > "), F.replace(snippet, F.lit("\n"), F.lit(" ")), F.lit("\n")), F.lit("")))
    return F.concat(F.lit("### "), link, F.coalesce(F.concat(snippet, F.lit("\n")), F.lit("")), F.lit("---\n"))


def result_block(title: Column, url: Column, snippet: Column, density: int) -> Column:
    """One search result as a front-matter block."""
    body = F.concat(F.lit("### [" if density > 2 else "- ["), title, F.lit("]("), url, F.lit(")"))
    if density > 1:
        shown = snippet if density > 2 else F.replace(snippet, F.lit("\n"), F.lit(" "))
        body = F.concat(body, F.coalesce(F.concat(F.lit("\n\n"), shown), F.lit("")))
    return structured(url, title, "search_result", body)


def result_page(ranked: DataFrame, density: int, form: str = "md") -> DataFrame:
    """(query_id, page): ranked rows (query_id, final_rank, url, title, snippet) as one text; form is md, plain or structured.

    A page holds one query's results, which its caller has limited."""
    if form not in ("md", "plain", "structured") or density not in (1, 2, 3):
        raise ValueError(f"no such form or density: {form}, {density}")
    one = result_block if form == "structured" else result_text
    text = one(F.col("title"), F.col("url"), F.col("snippet"), density)
    page = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("final_rank", text.alias("text")))).alias("xs"))
    whole = F.array_join(F.transform("xs", lambda x: x["text"]), "\n\n" if form == "structured" else "")
    whole = whole if form == "structured" else stripped(whole)
    return page.select("query_id", (plain(whole) if form == "plain" else whole).alias("page"))


def formatted(body: Column, source: Column, form: str, kind: str = "generic", fallback_title: Column | None = None) -> Column:
    """A page's text in one of the three forms; a front-matter block's title is the fallback, else the first line that says something, else the source."""
    if form == "md":
        return body
    if form == "plain":
        return plain(body)
    if form != "structured":
        raise ValueError(f"no such form: {form}")
    titles = ([fallback_title] if fallback_title is not None else []) + [T.title_line(body), source]
    return structured(source, F.coalesce(*titles), kind, body)
