"""Text statistics, markers, cleanup and minification as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def lines(text: Column) -> Column:
    """Lines without a last empty one."""
    return F.split(F.regexp_replace(text, "\n$", ""), "\n")


def _count(items: Column, test) -> Column:
    return F.size(F.filter(items, test)).cast("bigint")


#: A fenced stretch: from a line that opens it to the one that closes it, or the end.
FENCED = r"(?msd)^[ \t\r]*```.*?(?:^[ \t\r]*```[^\n]*$|\z)"


def outside_fences(text: Column) -> Column:
    """The text without fenced code and its fence lines."""
    return F.regexp_replace(text, r"(?ms)^[ \t]*```.*?(^[ \t]*```[^\n]*$\n?|\z)", "")


def by_fences(text: Column, outside, inside) -> Column:
    """The text with its parts outside and inside of fences rewritten by two functions of columns."""
    plain, fenced = F.split(text, FENCED), F.regexp_extract_all(text, F.lit(FENCED), F.lit(0))
    parts = F.transform(plain, lambda x, i: F.concat(outside(x), F.coalesce(inside(F.get(fenced, i)), F.lit(""))))
    return F.array_join(parts, "")


def stats(text: Column) -> dict[str, Column]:
    """The counters that candidates are scored by."""
    plain = outside_fences(text)
    rows = F.transform(lines(plain), lambda x: F.trim(x))
    return {
        "words": word_count(text),
        "headings": _count(rows, lambda x: x.startswith("#")),
        "code_fences": _count(lines(text), lambda x: F.trim(x).startswith("```")),
        "list_items": _count(rows, lambda x: x.startswith("- ") | x.rlike(r"^[0-9]+\. ")),
        "short_lines": _count(rows, lambda x: (x != "") & (F.octet_length(x) < 35)),
        "links": F.size(F.split(plain, r"\]\(")).cast("bigint") - 1,
        "paragraphs": _count(F.split(text, "\n\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != ""),
        "bytes": F.octet_length(text).cast("bigint"),
    }


def _any(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


def price_lines(text: Column) -> Column:
    return _count(lines(text), lambda x: _any(x, V.PRICE_PHRASES))


def spec_lines(text: Column) -> Column:
    return _count(lines(text), lambda x: _any(F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), V.SPEC_PHRASES))


def cleanup(text: Column) -> Column:
    """Lines lose trailing blanks; one blank line goes, two or more become one; ends are trimmed."""
    t = F.regexp_replace(text, r"[ \t\r]+(?=\n|$)", "")
    t = F.regexp_replace(t, "\n{3,}", "\u0001")
    t = F.regexp_replace(t, "\n\n", "\n")
    return F.regexp_replace(F.replace(t, F.lit("\u0001"), F.lit("\n\n")), r"^\s+|\s+$", "")


_WS, _NOT_WS = "[ \\t\\r\\n]", "[^ \\t\\r\\n]"


def shorten_tokens(text: Column) -> Column:
    """Base64 runs of 80 characters or more and hex hashes of 40 to 64, where they are whole tokens, give way to a mark."""
    t = F.regexp_replace(text, f"(?<!{_NOT_WS})[A-Za-z0-9+/=]{{80,}}(?!{_NOT_WS})", "[BASE64_TRUNCATED]")
    return F.regexp_replace(t, f"(?<!{_NOT_WS})[0-9a-fA-F]{{40,64}}(?!{_NOT_WS})", "[SHA_TRUNCATED]")


def collapse_space(text: Column) -> Column:
    """A run of white space becomes two line breaks, one, or a blank, by the line breaks that it has."""
    t = F.regexp_replace(text, r"[ \t\r]+", " ")
    t = F.regexp_replace(t, " ?\n ?\n[ \n]*", "\n\n")
    return F.regexp_replace(t, "(?<!\n) ?\n ?(?!\n)", "\n")


def simplify_links(text: Column) -> Column:
    """Links whose target says nothing lose it: to fragments, relative places, or their own label.

    Rooted and absolute targets, mail addresses, and links without label or target stay."""
    own = r"\[([^\]\n]+)\]\(\1\)"
    kept = r"(\[\]\([^)\n]*\)|\[[^\]\n]*\]\((?:(?!#)(?:[^)\n]*://[^)\n]*|/[^)\n]*|mailto:[^)\n]*))?\))"
    return F.regexp_replace(text, f"{own}|{kept}|" + r"\[([^\]\n]+)\]\([^)\n]+\)", "$1$2$3")


def simplify_lines(text: Column) -> Column:
    """Outside of fences: lines of interface text go, headings lose their anchors, links are simplified, lines lose trailing blanks."""

    def outside(t: Column) -> Column:
        # a part keeps the line break before a fence and the one after it
        t = F.regexp_replace(t, r"(?md)^[ \t\r]*(?:" + "|".join(V.UI_LINES) + r")[ \t\r]*$\n?", "")
        t = F.regexp_replace(t, r"(?md)^([ \t]*#[^\n]*?)\[?§\]\(#[^)\n]*\)", "$1")
        return F.regexp_replace(simplify_links(t), r"(?md)[ \t\r]+$", "")

    return by_fences(text, outside, lambda t: t)


def minify(text: Column) -> Column:
    """Lines simplified, then space collapsed and tokens shortened outside of triple backticks; never longer than the trimmed input."""
    parts = F.split(F.concat(simplify_lines(text), F.lit("\n")), "```")
    outside = lambda t: shorten_tokens(collapse_space(F.regexp_replace(t, f"({_WS}+)(`{{1,2}})(?={_WS}|$)", "$2$1")))
    made = F.array_join(F.transform(parts, lambda t, i: F.when(i % 2 == 1, t).otherwise(outside(t))), "```")
    made = F.when(F.size(parts) % 2 == 1, F.regexp_replace(made, f"{_WS}+$", "")).otherwise(made)
    made, plain = F.regexp_replace(made, "^\n+", ""), F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.octet_length(made) > F.octet_length(plain), plain).otherwise(made)


def title_line(text: Column) -> Column:
    """The first line with something to say, without its marks of a heading, quote or list; null if none does.

    Comments, rules and source lines say nothing."""
    rows = F.filter(F.transform(lines(text), lambda x: F.trim(x)), lambda x: ~(x.startswith("<!--") | (x == "---") | x.startswith("# --- [Source:")))
    bare = lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(F.regexp_replace(x, "^#+", "")), "^>+", "")), r"^(?:- )*(?:\* )*", ""))
    return F.get(F.filter(F.transform(rows, bare), lambda x: x != ""), F.lit(0))


def is_leaf(text: Column) -> Column:
    """A JSON string that reads like content."""
    return (F.octet_length(text) > 20) & (F.size(F.split(text, " ")) > 2)


def family_adjustment(s: dict[str, Column], price: Column, spec: Column) -> dict[str, Column]:
    """Points that a page family adds to a candidate."""
    h, f, l, p, k, short, w = s["headings"], s["code_fences"], s["list_items"], s["paragraphs"], s["links"], s["short_lines"], s["words"]
    tenth = lambda d: F.floor(w / d).cast("bigint")
    return {
        "docs": 12 * h + 18 * f + 4 * l - short,
        "article": 14 * p + tenth(20) - 2 * k,
        "product": 16 * h + 12 * l + 40 * price + 22 * spec - 4 * k,
        "listing": 10 * p + 2 * k - short,
        "search": 8 * p + 3 * k - 4 * h,
        "forum": 16 * p + tenth(30) - 3 * k,
        "generic": F.lit(0).cast("bigint"),
    }
