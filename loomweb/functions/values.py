"""Fixed values that results depend on."""

# Query keys that track visitors.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id",
    "fbclid", "gclid", "gclsrc", "dclid", "gbraid", "wbraid", "msclkid", "twclid", "ttclid",
    "mc_cid", "mc_eid", "_hsenc", "_hsmi", "hsCtaTracking", "ref", "referrer", "source", "campaign",
]
# Hosts and path parts of the URL pattern scorer.
DOCS_HOSTS = ["docs.rs", "doc.rust-lang.org", "developer.mozilla.org", "pkg.go.dev", "docs.python.org", "cppreference.com", "api.dart.dev"]
DOCS_PATHS = ["/docs/", "/reference/", "/api/", "/guide/", "/manual/", "/book/", "/stable/", "/latest/"]
FARM_HOSTS = ["medium.com", "dev.to", "hashnode.dev", "hashnode.com", "blogspot.com", "wordpress.com", "substack.com", "dzone.com", "hackernoon.com"]
FARM_PATHS = ["/what-is-", "/beginners-guide-", "/introduction-to-", "/getting-started-with-"]
# Trust tiers and the block list.
HIGH_TRUST = [
    "docs.rs", "doc.rust-lang.org", "crates.io", "github.com", "pypi.org", "npmjs.com", "pkg.go.dev", "developer.mozilla.org",
    "developer.apple.com", "docs.python.org", "cppreference.com", "rust-lang.org", "golang.org", "python.org", "nodejs.org",
    "kotlinlang.org", "swift.org", "tokio.rs", "serde.rs", "hyper.rs", "clap.rs",
]
MEDIUM_TRUST = ["stackoverflow.com", "reddit.com", "news.ycombinator.com", "unix.stackexchange.com", "superuser.com", "serverfault.com"]
BLOCKED = ["w3schools.com", "geeksforgeeks.org", "tutorialspoint.com", "javatpoint.com", "programiz.com"]
# Words that name no project.
COMMON_WORDS = [
    "rust", "with", "from", "into", "over", "that", "this", "when", "what", "have", "then", "they", "will", "about", "async", "await",
    "impl", "struct", "trait", "enum", "macro", "derive", "error", "using", "guide", "tutorial", "example", "code", "type", "docs",
    "file", "build", "test", "data", "http", "https", "json", "toml", "yaml",
]
# Scorer weights and the fusion constant.
WEIGHTS = {"domain_trust": 1.0, "domain_diversity": 0.5, "snippet_relevance": 0.6, "url_pattern": 0.8, "blocklist_penalty": 1.0, "project_match": 1.2}
RRF_K = 60.0
# Hosts with a page family, suffix rules, and path parts in order.
FAMILY_HOSTS = {
    "docs.rs": "docs", "developer.mozilla.org": "docs", "react.dev": "docs", "doc.rust-lang.org": "docs", "stackoverflow.com": "forum",
    "stackexchange.com": "forum", "reddit.com": "forum", "old.reddit.com": "forum", "news.ycombinator.com": "forum",
    "wikipedia.org": "knowledge", "en.wikipedia.org": "knowledge", "amazon.com": "product", "bestbuy.com": "product",
    "newegg.com": "product", "walmart.com": "product", "target.com": "product",
}
FAMILY_SUFFIXES = [(".readthedocs.io", "docs"), (".github.io", "docs"), (".gov", "knowledge")]
FAMILY_PATHS = [
    ("docs", ["/docs/", "/wiki/", "/guide/", "/tutorial/"]),
    ("product", ["/p/", "/product/", "/item/", "/shop/"]),
    ("article", ["/blog/", "/article/", "/news/", "/story/"]),
    ("search", ["/search", "/q/"]),
    ("forum", ["/forum/", "/thread/", "/discuss/"]),
]
# Phrases that mark prices and specifications.
PRICE_PHRASES = ["$", "Current price", "Sale price", "Price when purchased"]
SPEC_PHRASES = ["specifications", "specs", "product details", "about this item", "key features", "warranty", "dimensions", "brand", "model", "isbn", "sku"]
# Lines of documentation pages that only label controls.
UI_LINES = ["Copy item path", "Expand description"]
# Id and class parts that tell a candidate's family, and those of result cards.
DOC_HINTS = [
    "doc", "docs", "reference", "api", "manual", "guide", "guides", "tutorial", "learn", "developer", "developers", "readthedocs", "gitbook", "docusaurus",
]
PRODUCT_HINTS = ["product", "pdp", "buybox", "price", "pricing", "spec", "specs", "sku", "item", "details", "purchase", "cart", "merchant", "offer"]
ARTICLE_HINTS = ["article", "post", "story", "blog", "news", "entry", "content", "prose"]
RESULT_HINTS = ["result", "hit", "item", "product", "listing"]
# Statuses that are worth another try, and those that mean a block.
RETRY_STATUS, BLOCK_STATUS = [429, 500, 502, 503, 504], [403, 429]
# The cloud reader's prefix for an URL, and the note before what it returns.
CLOUD_READER, CLOUD_NOTE = "https://r.jina.ai/", "<!-- Processed via Jina.ai Cloud Proxy -->\n\n"
# Platform hosts.
PLATFORMS = [
    ("github", ["github.com"]),
    ("reddit", ["reddit.com", "www.reddit.com", "old.reddit.com"]),
    ("hackernews", ["news.ycombinator.com"]),
    ("wikipedia", ["en.wikipedia.org"]),
    ("stackoverflow", ["stackoverflow.com"]),
    ("arxiv", ["arxiv.org"]),
    ("youtube", ["youtube.com", "www.youtube.com", "youtu.be"]),
]
# Tags, hints and limits of page extraction.
DROPPED_TAGS = ["nav", "footer", "header", "aside", "style", "svg", "iframe", "form", "script", "noscript"]
HINTED_TAGS = ["div", "section", "main", "article", "aside", "ul", "ol", "li"]
NEGATIVE_HINTS = [
    "nav", "menu", "sidebar", "footer", "header", "breadcrumb", "sitemap", "toolbar", "cookie", "modal", "popup", "banner", "notice",
    "disclosure", "overlay", "share", "social", "related", "recommend", "promo", "sponsor", "ad-", "advert", "utility", "newsletter",
    "subscribe", "carousel", "slider", "toc", "table-of-contents", "on-this-page", "in-this-article", "byline", "author-bio", "tags",
    "tag-list", "pagination", "page-nav", "widget", "chip", "pill", "annotation", "tooltip", "comment", "copyright", "legal",
]
POSITIVE_HINTS = ["article", "content", "main", "post", "entry", "body", "text", "doc", "docs", "markdown", "prose", "story"]
DIV_HINTS = ["content", "article", "post", "entry", "doc", "markdown", "prose", "story"]
MAX_PAGE_BYTES, MAX_CANDIDATES = 5 * 1024 * 1024, 32
