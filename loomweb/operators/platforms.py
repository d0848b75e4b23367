"""Platform content as Markdown at three densities (1 compact, 2 standard, 3 full), over parsed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RULE = "\n\n---\n\n"
ISSUES, REDDIT_COMMENTS, HN_COMMENTS, TRANSCRIPT = 20, 2, 5, 500


def _thread(title: Column, text: Column, comments: Column, density: int, most: int) -> Column:
    if density == 1:
        return F.concat(F.lit("- ["), title, F.lit("]"))
    shown = F.slice(comments, 1, most) if density == 2 else comments
    said = F.when(F.size(comments) > 0, F.concat(F.lit("\n\n## Comments\n\n"), F.array_join(shown, RULE))).otherwise("")
    return F.concat(F.lit("# "), title, text, said)


def reddit(title: Column, selftext: Column, comments: Column, density: int) -> Column:
    return _thread(title, F.concat(F.lit("\n\n"), selftext), comments, density, REDDIT_COMMENTS)


def hacker_news(title: Column, text: Column, comments: Column, density: int) -> Column:
    return _thread(title, F.coalesce(F.concat(F.lit("\n\n"), text), F.lit("")), comments, density, HN_COMMENTS)


def answers(title: Column, found: Column, density: int) -> Column:
    """found holds (body, score, is_accepted) in their order."""
    shown = F.slice(found, 1, {1: 1, 2: 3}.get(density, 1 << 30))

    def one(a: Column) -> Column:
        head = F.when(a["is_accepted"], "### ✅ Accepted Answer [Score: ").otherwise("### [Score: ")
        return F.concat(head, a["score"].cast("string"), F.lit("]\n\n"), a["body"], F.lit(RULE))

    return F.concat(F.lit("# "), title, F.lit("\n\n## Answers\n\n"), F.array_join(F.transform(shown, one), ""))


def paper(title: Column, authors: Column, published: Column, abstract: Column, identifier: Column, density: int) -> Column:
    if density == 1:
        return F.concat(F.lit("- ["), title, F.lit("]("), identifier, F.lit(")"))
    names = F.when(F.size(authors) == 0, "Unknown").when(F.size(authors) <= 3, F.array_join(authors, ", ")).otherwise(F.concat(F.get(authors, F.lit(0)), F.lit(" et al.")))
    facts = F.concat(F.lit("**Authors:** "), names, F.lit("\n**Published:** "), published, F.lit("\n**ArXiv:** "), identifier, F.lit("\n\n")) if density == 3 else F.lit("")
    return F.concat(F.lit("# "), title, F.lit("\n\n"), facts, F.lit("## Abstract\n\n"), abstract)


def video(title: Column, channel: Column, channel_url: Column, transcript: Column, density: int) -> Column:
    head = F.concat(F.lit("# "), title, F.lit("\n\n**Channel:** ["), channel, F.lit("]("), channel_url, F.lit(")\n"))
    if density == 1:
        return head
    cut = F.concat(F.lit("\n## Transcript Snippet\n\n"), F.substring(transcript, 1, TRANSCRIPT), F.when(F.octet_length(transcript) > TRANSCRIPT, "... (truncated)").otherwise(""))
    whole = F.concat(F.lit("\n## Transcript\n\n"), transcript)
    return F.concat(head, F.when(F.coalesce(transcript, F.lit("")) != "", cut if density == 2 else whole).otherwise(""))


def issue(number: Column, title: Column, labels: Column, author: Column, body: Column, comments: Column, density: int) -> Column:
    """comments holds (login, body)."""
    tags = F.array_join(labels, ", ")
    if density == 1:
        return F.concat(F.lit("- [#"), number.cast("string"), F.lit("] "), title, F.lit(" [Labels: "), tags, F.lit("]\n"))
    head = F.concat(F.lit("# [#"), number.cast("string"), F.lit("] "), title, F.lit("\n**Labels**: "), tags, F.lit("\n**Author**: "), author, F.lit("\n\n"), F.coalesce(body, F.lit("")))
    said = F.transform(comments, lambda c: F.concat(F.lit("### "), c["login"], F.lit("\n"), F.coalesce(c["body"], F.lit("")), F.lit(RULE)))
    return head if density == 2 else F.concat(head, F.lit("\n\n## Comments\n\n"), F.array_join(said, ""))


def issues(owner: Column, repo: Column, rows: Column) -> Column:
    """rows holds (number, title, html_url, labels); the first ISSUES are listed."""
    line = lambda r: F.concat(F.lit("- [#"), r["number"].cast("string"), F.lit("] "), r["title"], F.lit(" ("), r["html_url"], F.lit(") [Labels: "), F.array_join(r["labels"], ", "), F.lit("]\n"))
    return F.concat(F.lit("# Issues for "), owner, F.lit("/"), repo, F.lit("\n\n"), F.array_join(F.transform(F.slice(rows, 1, ISSUES), line), ""))


def readme(text: Column, density: int) -> Column:
    """Headings; headings and fenced code; all."""
    rows = F.split(F.regexp_replace(text, "\n$", ""), "\n")
    if density == 1:
        return F.array_join(F.filter(rows, lambda x: x.startswith("# ") | x.startswith("## ") | x.startswith("### ")), "\n")
    if density == 3:
        return text
    start = F.struct(F.lit(False).alias("code"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fence = x.startswith("```")
        keep = fence | s["code"] | x.startswith("#")
        return F.struct(F.when(fence, ~s["code"]).otherwise(s["code"]).alias("code"), F.when(keep, F.concat(s["out"], F.array(F.concat(x, F.lit("\n"))))).otherwise(s["out"]).alias("out"))

    return F.array_join(F.aggregate(rows, start, step, lambda s: s["out"]), "")


def source_kind(url: Column, query: Column, platform: Column) -> Column:
    """What a session log calls a request."""
    return F.when(query.isNotNull(), "search").when(url.isNull(), "none").otherwise(platform)
