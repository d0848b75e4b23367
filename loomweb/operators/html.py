"""HTML pages to candidate Markdown blocks, links, thread posts and hints, in one Arrow function per worker.

A page is parsed once, its Markdown is made once per element from the bottom up, and all results are taken from that.  An end
tag without an open element is ignored, any other closes what is open inside it.  Elements nested deeper than ``MAX_DEPTH``
become siblings, as in browsers, which bounds the work for a page by its size.  Entities are left as they stand.  Scoring the
candidates is left to columns (candidates.py).

Every page gets a row.  Its status is ok, empty (no text), too_large (over 5 MiB) or error (what could not be parsed, with no results)."""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import values as V

# Elements without content, those whose children make one line, and classes of posts and scores in the order in which they are sought.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "a", "em", "i", "strong", "b", "li", "th", "td", "span", "small", "time", "label", "summary", "details"}
POSTS = ("post", "comment", "answer", "message")
SCORES = ("score", "vote-count", "upvote-count")
#: Elements whose text is not markup.
RAW = {"script", "style"}
MAX_DEPTH = 256
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|</(?P<end>[A-Za-z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<(?P<start>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|(?P<text>[^<]++|<)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_AFTER, _BEFORE, _RUN = re.compile(r"([(\[{\n]) +"), re.compile(r" (?<!  )(?=[,.;:!?)\]}])"), re.compile("  +")
_NEGATIVE = re.compile("|".join(map(re.escape, V.NEGATIVE_HINTS)))


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "depth")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent
        self.depth = parent.depth + 1 if parent else 0

    @property
    def hints(self) -> str:
        return " ".join(self.attrs[k] for k in ("id", "class") if k in self.attrs).lower()


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def parse(html: str) -> Node:
    root = at = Node("", {}, None)
    pos, size = 0, len(html)
    while pos < size:
        m = _TOKEN.match(html, pos)
        pos = m.end()
        if (text := m["text"]) is not None:
            at.children.append(text)
        elif m["start"]:
            tag = m["start"].lower()
            closed = m["attrs"].endswith("/")
            node = Node(tag, _attributes(m["attrs"]), at)
            at.children.append(node)
            if tag in RAW and not closed:
                end = re.compile(rf"</{tag}\b[^>]*+>", re.I).search(html, pos)
                node.children.append(html[pos : end.start() if end else size])
                pos = end.end() if end else size
            elif tag not in VOID and not closed and node.depth < MAX_DEPTH:
                at = node
        elif m["end"]:
            up, tag = at, m["end"].lower()
            while up.parent and up.tag != tag:
                up = up.parent
            if up.parent:
                at = up.parent
    return root


def walk(node: Node) -> Iterator[Node]:
    """All elements in document order, the node itself first."""
    stack = [node]
    while stack:
        one = stack.pop()
        yield one
        stack += [c for c in reversed(one.children) if isinstance(c, Node)]


def _dropped(node: Node) -> bool:
    return node.tag in V.DROPPED_TAGS or (node.tag in V.HINTED_TAGS and _NEGATIVE.search(node.hints) is not None)


def clean(text: str) -> str:
    """Lines lose trailing blanks; of blank lines one goes, more become one; the ends are trimmed."""
    text = "\n".join([x.rstrip() for x in text.split("\n")])
    return re.sub(r"\n{2,}", lambda m: "\n" if len(m[0]) == 2 else "\n\n", text).strip()


def _spaced(text: str) -> str:
    """No space after opening signs, none alone before closing ones, and none twice."""
    return _RUN.sub(" ", _BEFORE.sub("", _AFTER.sub(r"\1", text))).strip()


def inner_text(node: Node) -> str:
    out, stack = [], list(reversed(node.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            out.append(c)
        else:
            stack += reversed(c.children)
    return "".join(out)


def strip_tracking(href: str) -> str:
    """As the column of that name, for one absolute URL."""
    m = re.match(r"^(https?)://([^/?#]+)([^?#]*)(?:\?([^#]*))?", href)
    if not m:
        return href
    pairs = [p for p in (m[4] or "").split("&") if p and p.split("=", 1)[0] not in V.TRACKING]
    return f"{m[1]}://{m[2].lower()}{m[3] or '/'}{'?' + '&'.join(pairs) if pairs else ''}"


def _shape(text: str) -> tuple[int, int, int]:
    """(list items, paragraphs, short lines) of Markdown, as the columns of these names count them."""
    items = short = 0
    fenced = False
    for x in (y.strip() for y in text.split("\n")):
        if x.startswith("```"):
            fenced = not fenced
        elif x and not fenced:
            items += x.startswith("- ") or re.match(r"[0-9]+\. ", x) is not None
            short += len(x.encode()) < 35
    return items, sum(1 for x in text.split("\n\n") if x.strip()), short


class Page:
    """One parsed page; made[node] is the Markdown of an element, blocks[node] that of its children as blocks."""

    def __init__(self, html: str):
        self.root = parse(html)
        self.nodes = list(walk(self.root))
        self.made: dict[Node, str] = {}
        self.blocks: dict[Node, str] = {}
        #: Bytes of text, of these in links, and whether there is a table below.
        self.sizes: dict[Node, tuple[int, int, bool]] = {}
        for node in reversed(self.nodes):  # children before parents
            total = linked = 0
            table = False
            for c in node.children:
                if isinstance(c, str):
                    total += len(c.strip().encode())
                else:
                    t, k, has = self.sizes[c]
                    total, linked, table = total + t, linked + k, table or has or c.tag == "table"
            self.sizes[node] = total, total if node.tag == "a" else linked, table
            self.made[node] = "" if _dropped(node) else self._markdown(node)

    def _parts(self, node: Node) -> list[str]:
        return [x for c in node.children if (x := " ".join(c.split()) if isinstance(c, str) else self.made[c])]

    def _inline(self, node: Node) -> str:
        return _spaced(" ".join(x for x in self._parts(node) if x.strip()))

    def _block(self, node: Node) -> str:
        """Children one after the other, with a space where no line ends or begins."""
        if node not in self.blocks:
            out: list[str] = []
            for x in self._parts(node):
                if out and not out[-1].endswith("\n") and not x.startswith("\n"):
                    out.append(" ")
                out.append(x)
            self.blocks[node] = "".join(out)
        return self.blocks[node]

    def _markdown(self, node: Node) -> str:
        tag = node.tag
        if tag in INLINE:
            text = self._inline(node)
            if tag == "a":
                href = strip_tracking(node.attrs.get("href", ""))
                return f"[{text or href}]({href})" if href else text
            if not text:
                return ""
            if tag[0] == "h":
                return f"\n\n{'#' * int(tag[1])} {text}\n\n"
            mark = {"em": "*", "i": "*", "strong": "**", "b": "**", "p": "\n\n"}.get(tag, "")
            return f"{mark}{text}{mark}"
        if tag == "br":
            return "\n"
        if tag == "hr":
            return "\n\n---\n\n"
        if tag == "img":
            alt = " ".join(node.attrs.get("alt", "").split())
            return f"[Image: {alt}]" if alt else ""
        if tag == "code":
            code = " ".join(inner_text(node).split())
            return f"`{code}`" if code else ""
        if tag == "pre":
            first = node.children[0] if node.children else None
            names = first.attrs.get("class", "").split() if isinstance(first, Node) and first.tag == "code" else []
            language = next((x.removeprefix("language-") for x in names if x.startswith("language-")), "")
            code = inner_text(node).replace("\r", "").strip("\n")
            return f"\n\n```{language}\n{code}\n```\n\n" if code.strip() else ""
        if tag == "blockquote":
            body = clean(self._block(node))
            return "\n\n" + "\n".join(f"> {x}" if x else ">" for x in body.split("\n")) + "\n\n" if body else ""
        if tag in ("ul", "ol"):
            bodies = [b for c in node.children if isinstance(c, Node) and c.tag == "li" and (b := clean(self._block(c)))]
            marks = ["- " if tag == "ul" else f"{n}. " for n in range(1, len(bodies) + 1)]
            return "\n\n" + "\n".join(m + b.replace("\n", "\n  ") for m, b in zip(marks, bodies)) + "\n\n" if bodies else ""
        if tag == "table":
            cells = [[self._inline(c) for c in x.children if isinstance(c, Node) and c.tag in ("th", "td")] for x in self._rows(node)]
            rows = [" | ".join(filter(None, r)) for r in cells if any(r)]
            return "\n\n" + "".join(f"| {r} |\n" for r in rows) + "\n" if rows else ""
        if tag in ("section", "div", "aside") and self._saturated(node):
            return ""
        return self._block(node)

    def _rows(self, table: Node) -> Iterator[Node]:
        """Rows of a table, in its sections too; not those of tables in its cells."""
        stack = [table]
        while stack:
            one = stack.pop()
            if one.tag == "tr":
                yield one
            else:
                stack += [c for c in reversed(one.children) if isinstance(c, Node) and c.tag in ("thead", "tbody", "tfoot", "tr")]

    def _saturated(self, node: Node) -> bool:
        """A block that is mostly links, unless it holds a table or is laid out as a listing."""
        total, linked, table = self.sizes[node]
        if total < 30 or linked <= 0.4 * total or table:
            return False
        items, paragraphs, short = _shape(clean(self._block(node)))
        return not (paragraphs >= 3 and short >= 4) or (items >= 4 and paragraphs <= 2)

    def candidates(self) -> list[tuple[int, int, str, str, str]]:
        """(ord, depth, tag, hints, text) in the order in which ties are settled; where there are none, all of the body."""
        of = lambda tag: [n for n in self.nodes if n.tag == tag]
        picked = [(n, 0) for tag in ("main", "article") for n in of(tag)]
        picked += [(n, 1) for tag in ("section", "table") for n in of(tag)[: V.MAX_CANDIDATES]]
        divs = of("div")
        for hint in V.DIV_HINTS:
            for attr in ("id", "class"):
                picked += [(n, 2) for n in [x for x in divs if hint in x.attrs.get(attr, "")][: V.MAX_CANDIDATES]]
        body = of("body")[:1]
        picked += [(n, 5) for n in body]
        known: dict[Node, str] = {}
        out = []
        for n, depth in picked:
            if n not in known:
                known[n] = clean(self.made[n])
            if known[n]:
                out.append((len(out), depth, n.tag, n.hints, known[n]))
        if not out and (rest := clean(self.made[body[0] if body else self.root])):
            out = [(0, 5, "body", "", rest)]
        return out

    def links(self) -> list[str]:
        """Content links of the first main, else of the first article, each once."""
        top = next((n for tag in ("main", "article") for n in self.nodes if n.tag == tag), None)
        found: dict[str, None] = {}
        stack = [top] if top else []
        while stack:
            n = stack.pop()
            if n.tag in V.DROPPED_TAGS:
                continue
            if n.tag == "a" and n.attrs.get("href"):
                found.setdefault(n.attrs["href"])
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]
        return list(found)

    def forum(self) -> str:
        """A thread: its first post, then replies with accepted ones first and by score, equal ones as they came.

        Posts are the elements of the first class that has any with text, else articles; a post's own score elements are no part of it."""
        for kind in (*POSTS, "article"):
            posts = []
            for n in self.nodes:
                if n.tag == "article" if kind == "article" else kind in _classes(n):
                    text = "".join(" ".join(c.split()) if isinstance(c, str) else "" if _score_kind(c) else self.made[c] for c in n.children)
                    if text.strip():
                        posts.append(("accepted" not in n.attrs.get("class", ""), -_score(n), text))
            if posts:
                first, *rest = posts
                parts = [f"### [Score: {-score}]{'' if other else ' (Accepted Answer)'}\n\n{text}\n\n" for other, score, text in sorted(rest, key=lambda p: p[:2])]
                return f"{first[2]}\n\n---\n\n## Answers\n\n" + "".join(parts)
        return ""

    def hints(self) -> tuple[str | None, str | None, bool]:
        """(og:type, first itemtype, whether the page looks like one of search results)."""
        og = next((n.attrs.get("content") for n in self.nodes if n.tag == "meta" and n.attrs.get("property") == "og:type"), None)
        schema = next((n.attrs["itemtype"] for n in self.nodes if "itemtype" in n.attrs), None)
        search = any(n.tag == "input" and n.attrs.get("type") == "search" for n in self.nodes) and any(n.tag == "form" for n in self.nodes)
        return og, schema, search and any(n.tag == "div" and any(h in n.attrs.get("class", "") for h in V.RESULT_HINTS) for n in self.nodes)

    def body_bytes(self, html: str) -> int:
        """Bytes of the body's text, of the whole page where it has no body."""
        body = next((n for n in self.nodes if n.tag == "body"), None)
        return len((inner_text(body) if body else html).encode())

    def state(self) -> str:
        """Content-like strings of a page's embedded state; keys in order."""
        script = next((n for n in self.nodes if n.tag == "script" and n.attrs.get("id") == "__NEXT_DATA__"), None)
        try:
            return clean("\n\n".join(json_strings(json.loads(inner_text(script))))) if script else ""
        except (ValueError, RecursionError):
            return ""


def _classes(node: Node) -> list[str]:
    return node.attrs.get("class", "").split()


def _score_kind(node: Node) -> int:
    """1 to 4 for elements that hold a score, in the order in which they are asked; else 0."""
    classes = _classes(node)
    kind = next((n for n, c in enumerate(SCORES, 1) if c in classes), 0)
    return kind or 4 * (node.attrs.get("itemprop") == "upvoteCount")


def _score(post: Node) -> int:
    """The number in the first score element of a kind; kinds without a number are passed over."""
    first: dict[int, Node] = {}
    for n in walk(post):
        for kind in {k for k, c in enumerate(SCORES, 1) if c in _classes(n)} | ({4} if n.attrs.get("itemprop") == "upvoteCount" else set()):
            if n is not post:
                first.setdefault(kind, n)
    for kind in sorted(first):
        text = re.sub(r"[^0-9+-]", "", inner_text(first[kind]))
        if re.fullmatch(r"[+-]?[0-9]{1,10}", text) and -(1 << 31) <= int(text) < 1 << 31:
            return int(text)
    return 0


def json_strings(value) -> list[str]:
    """Strings of over 20 bytes with two spaces or more, trimmed; keys of objects in order."""
    out, stack = [], [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            v = v.strip()
            if len(v.encode()) > 20 and v.count(" ") >= 2:
                out.append(v)
        elif isinstance(v, list):
            stack += reversed(v)
        elif isinstance(v, dict):
            stack += [v[k] for k in sorted(v, reverse=True)]
    return out


# Labels that stand for wider character sets.
LABELS = {
    "ascii": "cp1252", "us-ascii": "cp1252", "latin1": "cp1252", "iso-8859-1": "cp1252", "iso8859-1": "cp1252", "shift_jis": "cp932", "shift-jis": "cp932",
    "sjis": "cp932", "x-sjis": "cp932", "gb2312": "gbk", "euc-kr": "cp949", "ks_c_5601-1987": "cp949", "iso-8859-9": "cp1254", "tis-620": "cp874",
}
BOMS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


def decode(raw: bytes, content_type: str | None = None) -> str:
    """Text of a body: by its byte order mark, the charset of its content type, that of its first 4,096 bytes, or UTF-8; bad bytes are replaced."""
    for mark, name in BOMS:
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace")
    named = [p.partition("=")[2].strip().strip('"') for p in (content_type or "").split(";")[1:] if p.partition("=")[0].strip().lower() == "charset"]
    meta = re.search(rb"charset\s*=\s*\"?([^\"';\s]{1,32})", raw[:4096], re.I)
    for label in (*named, meta and meta[1].decode("ascii", "ignore"), "utf-8"):
        try:
            return raw.decode(LABELS.get((label or "").lower(), label or ""), "replace")
        except LookupError:
            continue
    return ""


CANDIDATES = "candidates array<struct<ord:int,depth:int,tag:string,hints:string,text:string>>"
PARTS = f"page_id bigint, url string, status string, {CANDIDATES}, links array<string>, forum string, state string, og_type string, item_type string, is_search boolean, body_bytes bigint"


def page_fields(html: str) -> tuple:
    """What PARTS has after the URL."""
    if len(html.encode()) > V.MAX_PAGE_BYTES:
        return "too_large", [], [], "", "", None, None, False, None
    try:
        page = Page(html)
        found = [dict(zip(("ord", "depth", "tag", "hints", "text"), c)) for c in page.candidates()]
        links, forum, state, hints, size = page.links(), page.forum(), page.state(), page.hints(), page.body_bytes(html)
    except Exception:  # one page must not end the job; its row says so
        return "error", [], [], "", "", None, None, False, None
    return "ok" if found or state else "empty", found, links, forum, state, *hints, size


def page_parts(pages: DataFrame) -> DataFrame:
    """PARTS of pages(page_id, url, html), where html is text, or bytes with an optional column content_type.  A null page is an empty one."""
    kind = pa.list_(pa.struct([("ord", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("hints", pa.string()), ("text", pa.string())]))
    kinds = [pa.string(), kind, pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64()]
    names = ["page_id", "url", "status", "candidates", "links", "forum", "state", "og_type", "item_type", "is_search", "body_bytes"]
    content_type = F.col("content_type") if "content_type" in pages.columns else F.lit(None).cast("string")
    raw = isinstance(pages.schema["html"].dataType, BinaryType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, how in zip(batch.column(2), batch.column(3).to_pylist()):
                body = t.as_py() or ("" if not raw else b"")
                if raw and len(body) > V.MAX_PAGE_BYTES:
                    rows.append(("too_large", [], [], "", "", None, None, False, None))
                else:
                    rows.append(page_fields(decode(body, how) if raw else body))
            cols = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    return pages.select(F.col("page_id").cast("bigint"), "url", "html", content_type.alias("content_type")).mapInArrow(run, PARTS)


def decoded(pages: DataFrame) -> DataFrame:
    """pages(page_id, html as bytes, content_type) as (page_id, html) text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if raw is None else decode(raw, how) for raw, how in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["page_id", "html"])

    return pages.select(F.col("page_id").cast("bigint"), "html", "content_type").mapInArrow(run, "page_id bigint, html string")


def search_results(rows: DataFrame, payload: str, engine: str, engine_ord: int, limit: int = 20) -> DataFrame:
    """(query_id, engine, engine_ord, rank, url, title, snippet) of a column with a result page as HTML; snippets are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rank, urls, titles = [], [], [], []
            for n, t in enumerate(batch.column(1).to_pylist()):
                for k, (url, title) in enumerate(result_links(t or "", limit)):
                    at.append(n)
                    rank.append(k)
                    urls.append(url)
                    titles.append(title)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(rank, pa.int64()), pa.array(urls, pa.string()), pa.array(titles, pa.string())], names=["query_id", "rank", "url", "title"])

    found = rows.select(F.col("query_id").cast("bigint"), payload).mapInArrow(run, "query_id bigint, rank bigint, url string, title string")
    return found.select("query_id", F.lit(engine).alias("engine"), F.lit(engine_ord).alias("engine_ord"), "rank", "url", "title", F.lit(None).cast("string").alias("snippet"))


def result_target(href: str) -> str | None:
    """Where a result link leads: an absolute URL itself, else the uddg parameter of a redirect."""
    if href.startswith(("http://", "https://")):
        return href
    m = re.search(r"[?&]uddg=([^&#]*)", href)
    return unquote_plus(m[1]) if m else None


def result_links(html: str, limit: int) -> list[tuple[str, str]]:
    """(url, title) by the first kind of link that has any: result-link, result__a, or all; each URL once."""
    if limit <= 0:
        return []
    anchors = [n for n in walk(parse(html)) if n.tag == "a"]
    for wanted in ("result-link", "result__a", None):
        found: dict[str, str] = {}
        for n in anchors:
            if wanted is None or wanted in _classes(n):
                title, url = inner_text(n).strip(), result_target(n.attrs.get("href", ""))
                if title and url and len(found) < limit:
                    found.setdefault(url, title)
        if found:
            return list(found.items())
    return []
