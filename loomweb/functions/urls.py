"""URL equivalences and routing as column expressions; each kind of equivalence is its own function."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def is_http(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?://[^/?#]+"), F.lit(False))


def host(url: Column) -> Column:
    """Lower-case host without user info and port; '' where there is none."""
    return F.when(is_http(url), F.lower(F.regexp_replace(F.regexp_replace(_part(url, 2), "^.*@", ""), ":[0-9]*$", ""))).otherwise("")


def path(url: Column) -> Column:
    return _part(url, 3)


def host_matches(name: Column, domain: str) -> Column:
    return (name == domain) | name.endswith(f".{domain}")


def site_matches(name: Column, site: str) -> Column:
    """The --site predicate: site is trimmed, lower-cased and loses leading dots and www."""
    wanted = site.strip().lstrip(".").lower().removeprefix("www.")
    bare = F.regexp_replace(F.lower(name), r"^www\.", "")
    return F.lit(True) if not wanted else host_matches(bare, wanted)


def strip_tracking(url: Column) -> Column:
    """Without tracking pairs and fragment; a bare host gains its root slash; others unchanged."""
    pairs = F.filter(F.split(F.substring(_part(url, 4), 2, 1 << 20), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(V.TRACKING))
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    root = F.when(path(url) == "", "/").otherwise(path(url))
    return F.when(is_http(url), F.concat(F.lower(_part(url, 1)), F.lit("://"), F.lower(_part(url, 2)), root, query)).otherwise(url)


def _trimmed(url: Column) -> Column:
    return F.rtrim(path(url), F.lit("/"))


def normalize(url: Column) -> Column:
    """Canonical URL: no fragment, no trailing slashes of a non-root path, no tracking; null without a host."""
    kept = F.when(_trimmed(url) == "", "/").otherwise(_trimmed(url))
    return F.when(is_http(url), strip_tracking(F.concat(_part(url, 1), F.lit("://"), _part(url, 2), kept, _part(url, 4))))


def fusion_key(url: Column) -> Column:
    """Key under which ranked lists meet: trailing path slashes trimmed, query and fragment kept."""
    return F.when(is_http(url), F.concat(F.lower(_part(url, 1)), F.lit("://"), F.lower(_part(url, 2)), _trimmed(url), _part(url, 4), _part(url, 5))).otherwise(F.lower(url))


def eval_key(url: Column) -> Column:
    """Key of the evaluation: no fragment, trimmed path (root: /), tracking kept."""
    kept = F.when(_trimmed(url) == "", "/").otherwise(_trimmed(url))
    return F.when(is_http(url), F.concat(F.lower(_part(url, 1)), F.lit("://"), F.lower(_part(url, 2)), kept, _part(url, 4))).otherwise(url)


def gold_matches(candidate: Column, gold: Column) -> Column:
    c, g = F.rtrim(candidate, F.lit("/")), F.rtrim(gold, F.lit("/"))
    return (c == g) | c.startswith(F.concat(g, F.lit("/"))) | c.startswith(F.concat(g, F.lit("?")))


def cache_key(url: Column) -> Column:
    return F.sha2(F.coalesce(normalize(url), url), 256)


def route(text: Column) -> Column:
    """url or query."""
    return F.when(is_http(text), "url").otherwise("query")


def _segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda x: x != "")


def _query_value(url: Column, name: str) -> Column:
    """The decoded value of the first query pair of that name; null if there is none."""
    pairs = F.filter(F.split(F.substring(_part(url, 4), 2, 1 << 20), "&"), lambda p: F.substring_index(p, "=", 1) == name)
    first = F.get(pairs, F.lit(0))
    return F.try_url_decode(F.when(first.contains("="), F.substring(first, len(name) + 2, 1 << 20)).when(first.isNotNull(), ""))


def github_parts(url: Column) -> Column:
    """(owner, repo, kind, issue): kind is readme, issues or issue; pulls count as issues."""
    s = _segments(url)
    listed = F.coalesce(F.get(s, F.lit(2)).isin("issues", "pulls"), F.lit(False))
    number = F.when(listed & F.get(s, F.lit(3)).rlike("^[+]?[0-9]+$"), F.get(s, F.lit(3)).try_cast("bigint"))
    kind = F.when(number.isNotNull(), "issue").when(listed, "issues").otherwise("readme")
    return F.struct(F.get(s, F.lit(0)).alias("owner"), F.get(s, F.lit(1)).alias("repo"), kind.alias("kind"), number.alias("issue"))


def platform_item(url: Column) -> dict[str, Column]:
    """By platform, what names its item in the URL; null where the URL has none."""
    s, name = _segments(url), host(url)
    first, second = F.get(s, F.lit(0)), F.get(s, F.lit(1))
    video = F.when(name == "youtu.be", first).otherwise(F.coalesce(_query_value(url, "v"), F.when(first.isin("shorts", "embed", "v"), second)))
    return {
        "github": F.when(second.isNotNull(), F.concat(first, F.lit("/"), second)),
        "reddit": url,
        "hackernews": _query_value(url, "id"),
        "wikipedia": F.when(first == "wiki", second),
        "stackoverflow": F.when((first == "questions") & second.rlike("^[+]?[0-9]+$"), second.try_cast("bigint").cast("string")),
        "arxiv": F.when(first.isin("abs", "pdf"), F.regexp_replace(second, r"(?:\.pdf)+$", "")),
        "youtube": video,
    }


def platform(url: Column) -> Column:
    """The platform that an URL belongs to by its host and the item that it names, or generic."""
    item = platform_item(url)
    return F.coalesce(*[F.when(host(url).isin(hosts) & item[kind].isNotNull(), kind) for kind, hosts in V.PLATFORMS], F.lit("generic"))


def source_of(url: Column) -> Column:
    """(url, source_type, domain) under which a session log has an URL."""
    kind, item, hub = platform(url), platform_item(url), github_parts(url)
    at = F.when(hub["kind"] == "issue", F.concat(F.lit("/issues/"), hub["issue"].cast("string"))).when(hub["kind"] == "issues", "/issues").otherwise("")
    named = {
        "github": F.concat(F.lit("https://github.com/"), item["github"], at),
        "hackernews": F.concat(F.lit("https://news.ycombinator.com/item?id="), item["hackernews"]),
        "wikipedia": F.concat(F.lit("https://en.wikipedia.org/wiki/"), item["wikipedia"]),
        "stackoverflow": F.concat(F.lit("https://stackoverflow.com/questions/"), item["stackoverflow"]),
        "arxiv": F.concat(F.lit("https://arxiv.org/abs/"), item["arxiv"]),
    }
    domains = {"github": "github.com", "reddit": "reddit.com", "hackernews": "news.ycombinator.com", "wikipedia": "wikipedia.org", "stackoverflow": "stackoverflow.com", "arxiv": "arxiv.org", "youtube": "youtube.com"}
    whole = F.coalesce(*[F.when(kind == k, c) for k, c in named.items()], url)
    domain = F.coalesce(*[F.when(kind == k, d) for k, d in domains.items()], host(url))
    return F.struct(whole.alias("url"), kind.alias("source_type"), domain.alias("domain"))


def api_url(kind: Column, item: Column) -> Column:
    """Where a platform's item is served as data."""
    made = {
        "reddit": F.concat(F.rtrim(F.regexp_replace(item, "[?#].*$", ""), F.lit("/")), F.regexp_extract(item, r"(\?[^#]*)", 1), F.lit(".json")),
        "hackernews": F.concat(F.lit("https://hn.algolia.com/api/v1/items/"), item),
        "wikipedia": F.concat(F.lit("https://en.wikipedia.org/api/rest_v1/page/summary/"), item),
        "stackoverflow": F.concat(F.lit("https://api.stackexchange.com/2.3/questions/"), item, F.lit("/answers?order=desc&sort=votes&site=stackoverflow&filter=withbody")),
        "arxiv": F.concat(F.lit("https://export.arxiv.org/api/query?id_list="), item, F.lit("&max_results=1")),
        "youtube": F.concat(F.lit("https://www.youtube.com/oembed?url="), F.url_encode(item), F.lit("&format=json")),
        "openalex": F.concat(F.lit("https://api.openalex.org/works/"), item),
        "semantic_scholar": F.concat(F.lit("https://api.semanticscholar.org/graph/v1/paper/"), item),
    }
    return F.coalesce(*[F.when(kind == k, c) for k, c in made.items()])


def family_of_host(name: Column) -> Column:
    """Configured family: exact, exact without www., suffix rules in order, else generic."""
    exact = F.create_map(*[F.lit(x) for pair in V.FAMILY_HOSTS.items() for x in pair])
    bare = F.regexp_replace(name, r"^www\.", "")
    suffix = [F.when(name.endswith(s), f) for s, f in V.FAMILY_SUFFIXES]
    return F.coalesce(F.try_element_at(exact, name), F.try_element_at(exact, bare), *suffix, F.lit("generic"))


def family_hint(url: Column) -> Column:
    """Page family by host, else by the first path part that fits; null if none does."""
    found = family_of_host(host(url))
    by_path = [F.when(reduce(lambda a, b: a | b, [path(url).contains(p) for p in parts]), family) for family, parts in V.FAMILY_PATHS]
    return F.when(found.isin("docs", "article", "product", "forum", "listing", "search"), found).otherwise(F.coalesce(*by_path))


def probe_urls(url: Column) -> Column:
    """Where Markdown twins and site indexes may be, in the order in which they are asked; null where an URL has none.

    <url>.md unless the path ends in a slash, .md or .html; index.html.md beside it for paths that look like folders; then the site's llms files."""
    origin = F.concat(_part(url, 1), F.lit("://"), _part(url, 2))
    bare = F.when(path(url) == "", "/").otherwise(path(url))
    suffixed = F.when(~bare.rlike(r"(?:/|\.md|\.html)$"), F.concat(origin, bare, F.lit(".md"), _part(url, 4)))
    beside = F.when(bare.endswith("/") | ~bare.contains("."), F.concat(origin, F.regexp_replace(bare, "[^/]*$", ""), F.lit("index.html.md")))
    return F.array(suffixed, beside, *[F.concat(origin, F.lit(p)) for p in ("/llms-full.txt", "/llms.txt", "/.well-known/llms.txt")])


def _dots(p: Column) -> Column:
    """A path without . and .. parts."""
    parts = F.split(p, "/")
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, 1 << 20), F.array(F.lit("")), step)
    whole = F.array_join(kept, "/")
    return F.when(p.rlike(r"/\.{1,2}$"), F.concat(whole, F.lit("/"))).otherwise(F.when(whole == "", "/").otherwise(whole))


def resolve(base: Column, href: Column) -> Column:
    """A link's absolute URL on the base's host, without fragment and trailing slashes; null for other hosts and schemes."""
    origin = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    whole = (
        F.when(is_http(href), href)
        .when(href.startswith("//"), F.concat(_part(base, 1), F.lit(":"), href))
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("#") | (href == ""), base)
        .when(href.startswith("?"), F.concat(origin, path(base), href))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), href))
    )
    p = F.when(path(whole).rlike(r"/\.{1,2}(/|$)"), _dots(path(whole))).when(path(whole) == "", "/").otherwise(path(whole))
    p = F.when(F.rtrim(p, F.lit("/")) == "", "/").otherwise(F.rtrim(p, F.lit("/")))
    made = F.concat(F.lower(_part(whole, 1)), F.lit("://"), F.lower(_part(whole, 2)), p, _part(whole, 4))
    return F.when(host(whole) == host(base), made)


def is_retryable(status: Column) -> Column:
    return F.coalesce(status.isin(V.RETRY_STATUS), F.lit(False))


def fetch_error(status: Column) -> Column:
    """What a response without success means: Blocked or Network; null for success."""
    return F.when(status.isin(V.BLOCK_STATUS), "Blocked").when(~status.between(200, 299), "Network")


def exit_code(kind: Column) -> Column:
    """The exit code of an error kind: 0 without one, null for kinds that do not exist."""
    codes = {"Config": 1, "Network": 2, "Blocked": 3, "NoContent": 4, "InputTooLarge": 4}
    return F.when(kind.isNull(), 0).otherwise(F.coalesce(*[F.when(kind == k, n) for k, n in codes.items()]))
