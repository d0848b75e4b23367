from pyspark.sql import functions as F

from loomweb.functions import text as T
from loomweb.functions import urls


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


def test_tracking_and_root(spark):
    assert one(spark, urls.strip_tracking, "https://E.com?utm_source=a&q=1&ref=b#top") == "https://e.com/?q=1"
    assert one(spark, urls.strip_tracking, "/relative#x") == "/relative#x"
    assert one(spark, urls.normalize, "no url") is None


def test_equivalences_differ(spark):
    url = "https://e.com/a/?ref=1#f"
    assert one(spark, urls.normalize, url) == "https://e.com/a"
    assert one(spark, urls.fusion_key, url) == "https://e.com/a?ref=1#f"
    assert one(spark, urls.eval_key, url) == "https://e.com/a?ref=1"


def test_normalize_is_idempotent(spark):
    for url in ("https://e.com/a/?x=1&utm_id=2#z", "http://e.com", "http://e.com//"):
        once = one(spark, urls.normalize, url)
        assert one(spark, urls.normalize, once) == once


def test_site(spark):
    match = lambda site: (lambda c: urls.site_matches(c, site))
    assert one(spark, match(".Example.org"), "www.example.org")
    assert not one(spark, match("ample.org"), "example.org")
    assert one(spark, match(" "), "any")


def test_family_order(spark):
    assert one(spark, urls.family_hint, "https://en.wikipedia.org/wiki/x") == "docs"
    assert one(spark, urls.family_hint, "https://x.com/p/blog/1") == "product"
    assert one(spark, urls.family_hint, "https://x.readthedocs.io/") == "docs"
    assert one(spark, urls.family_hint, "https://x.com/") is None


def test_resolve(spark):
    rows = [("https://a.x/d/p", "q#f"), ("https://a.x/d/p", "//a.x/z/"), ("https://a.x/d/p", "mailto:m"), ("https://a.x/d", "https://b.x/"), ("https://a.x/d", "/")]
    found = [r[0] for r in spark.createDataFrame(rows, "b string, h string").select(urls.resolve(F.col("b"), F.col("h"))).collect()]
    assert found == ["https://a.x/d/q", "https://a.x/z", None, None, "https://a.x/"]


def test_cleanup(spark):
    assert one(spark, T.cleanup, "a  \n\nb\n\n\n\nc\n") == "a\nb\n\nc"
    assert one(spark, T.cleanup, "a\n\n\nb") == "a\n\nb"


def test_resolve_dots(spark):
    rows = [("https://a.x/d/e/p", h) for h in ("../q", "./q/", "../../../q", "/a/./b/../c", "?x=1", "..", "")]
    found = [r[0] for r in spark.createDataFrame(rows, "b string, h string").select(urls.resolve(F.col("b"), F.col("h"))).collect()]
    assert found == ["https://a.x/d/q", "https://a.x/d/e/q", "https://a.x/q", "https://a.x/a/c", "https://a.x/d/e/p?x=1", "https://a.x/d", "https://a.x/d/e/p"]


def test_items_of_platforms(spark):
    wanted = {
        "https://github.com/o/r/pulls/x": ("github", "o/r"), "https://github.com/o": ("generic", None), "https://news.ycombinator.com/x?id=": ("hackernews", ""), "https://arxiv.org/abs/1.2v3": ("arxiv", "1.2v3"),
        "https://www.youtube.com/embed/z": ("youtube", "z"), "https://www.youtube.com/feed": ("generic", None), "https://stackoverflow.com/questions/abc": ("generic", None),
    }
    item = lambda c: F.struct(urls.platform(c).alias("p"), F.coalesce(*[F.when(urls.platform(c) == k, x) for k, x in urls.platform_item(c).items()]).alias("i"))
    for url, want in wanted.items():
        assert tuple(one(spark, item, url)) == want, url


def test_minify_leaves_fences(spark):
    assert one(spark, T.minify, "a  b\n\n\n\n```\nx   y\n\n\n\nz\n```\n  c ` d") == "a b\n\n```\nx   y\n\n\n\nz\n```\nc` d"
    assert one(spark, T.minify, "a ```open   code") == "a ```open   code"


def test_minify_never_longer(spark):
    for text in ("a   b", "[x](#y) z", "f" * 45, "é ü", ""):
        assert len(one(spark, T.minify, text).encode()) <= len(text.strip().encode())


def test_fences_are_left_out(spark):
    s = one(spark, lambda c: F.struct(*[v.alias(n) for n, v in T.stats(c).items()]), "# h\n```\n# no\n[a](b)\n```\n- x\n1. y")
    assert (s["headings"], s["code_fences"], s["list_items"], s["links"]) == (1, 2, 2, 0)


def test_settings(tmp_path):
    import pytest

    from loomweb import config

    assert config.load([tmp_path / "none.toml"]).lists["low"] == [] and config.load([]).weights["rrf_k"] == 60.0
    (tmp_path / "a.toml").write_text('[search.trust]\nlow = ["Bad.x"]\n[search.blocklist]\ndomains = ["spam.x"]\n[search.scoring]\nrrf_k = 0\nurl_pattern = -3\n')
    found = config.load([tmp_path / "none.toml", tmp_path / "a.toml"])
    assert (found.low, found.blocked, found.weights["rrf_k"], found.weights["url_pattern"]) == (["bad.x"], ["spam.x"], 1.0, 0.0)
    assert "docs.rs" in found.high
    with pytest.raises(ValueError, match="no such weights"):
        config.weights_of({"typo": 1})
