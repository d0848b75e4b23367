from loomweb.operators import candidates, crawl, evaluate, find, html, ranking
from loomweb.streaming import log

LIST = "query_id long, engine string, engine_ord int, rank long, url string, title string, snippet string"


def test_consensus_wins_and_first_payload_stays(spark):
    rows = [(1, "a", 0, 0, "https://x.com/1/", "A1", None), (1, "a", 0, 1, "https://x.com/2", "A2", None), (1, "b", 1, 0, "https://x.com/2/", "B2", None)]
    found = ranking.fuse(spark.createDataFrame(rows, LIST)).orderBy("fused_rank").collect()
    assert [(r["title"], r["rrf"]) for r in found] == [("A2", round(1 / 62 + 1 / 61, 9)), ("A1", round(1 / 61, 9))]


def test_fusion_of_nothing(spark):
    assert ranking.fuse(spark.createDataFrame([], LIST)).count() == 0


def test_diversity_and_ties(spark):
    rows = [(1, "a", 0, n, f"https://h.com/{n}", "t", None) for n in range(3)]
    scored = ranking.score(ranking.fuse(spark.createDataFrame(rows, LIST)), spark.createDataFrame([(1, "zz")], "query_id long, query string"))
    assert [r["domain_diversity"] for r in scored.orderBy("final_rank").collect()] == [0.0, -0.25, -0.5]


def test_ndcg_passes_one(spark):
    ranked = spark.createDataFrame([(1, 1, "https://g.com/a"), (1, 2, "https://g.com/a/b")], "query_id long, rank long, url string")
    gold = spark.createDataFrame([(1, "https://g.com/a", True)], "query_id long, gold_url string, preferred boolean")
    assert evaluate.ndcg(ranked, gold).first()["ndcg"] > 1


def test_coordinate_ascent_moves_up():
    best = evaluate.coordinate_ascent(lambda w: -abs(w["a"] - 1.3), {"a": 1.0, "rrf_k": 60.0}, 0.1)
    assert round(best["a"], 6) == 1.3


def test_find_modes(spark):
    rows = spark.createDataFrame([(1, "Red fox\n\nblue\n\nred dog fox"), (2, "red\n\nnothing"), (3, "none")], "id int, t string")
    from pyspark.sql import functions as F

    found = {r["id"]: (r["match_mode"], r["filtered_text"]) for r in find.find_blocks(rows, F.col("t"), find.parse_terms("RED, fox,red")).collect()}
    assert found == {1: ("all", "Red fox\n\nred dog fox"), 2: ("partial", "red"), 3: ("none", "")}


def test_crawl_budget_and_cycles(spark):
    links = spark.createDataFrame([("https://a.x/", "/b", 0), ("https://a.x/b", "/", 0), ("https://a.x/b", "/c", 1)], "url string, href string, link_ord int")
    pages = spark.createDataFrame([("https://a.x/",), ("https://a.x/b",), ("https://a.x/c",)], "url string")
    seeds = pages.limit(1).toDF("seed")
    found = crawl.crawl(seeds, links, pages, max_depth=3, max_pages=2).orderBy("ord").collect()
    assert [(r["url"], r["depth"]) for r in found] == [("https://a.x/", 0), ("https://a.x/b", 1)]


PAGE = """<html><body><nav><a href=/n>n</a></nav><main><h1>T &amp; U</h1><p>One <b>two</b><br>three</p>
<ul><li>a<ul><li>b</li></ul></li><li></li><li>c</li></ul><pre><code class="language-py">x = 1
y</code></pre><table><tr><th>k</th><td></td><td>v</td></tr></table><blockquote>q</blockquote><img alt="pic"><a href="/in">in</a></main>
<div class="stock">gone</div><script>var t="</p>";</script></body></html>"""


def test_markdown():
    page = html.Page(PAGE)
    text = page.candidates()[0][4]
    for piece in ("# T &amp; U", "One **two** three", "- a\n  - b", "- c", "```py\nx = 1\ny\n```", "| k | v |", "> q", "[Image: pic]"):
        assert piece in text, piece
    assert "gone" not in text and "var t" not in text
    assert page.links() == ["/in"]


def test_every_page_has_a_row(spark):
    odd = ["", "</p><p>un<b>closed", "<div>" * 3000 + "deep", "<b>" * 600 + "bold", "<![foo <p>x</p>", "<![CDATA[a]]>b", "<!doctype", "<!-- never closed", "a < b <1> & c", "<p class='x>never", "<x" * 500, "\0\x01<p>\x02</p>", "<script>while(1)", "<table><table><tr><td><table><tr><td>x", "<ul><li><ol><li>" * 200 + "x"]
    pages = spark.createDataFrame([(n, "https://e.com/x", t) for n, t in enumerate([None, *odd, "z" * (5 << 20) + "zz"])], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in candidates.best_candidates(html.page_parts(pages)).collect()}
    assert len(found) == len(odd) + 2
    assert found[0]["status"] == "empty" and found[len(odd) + 1]["status"] == "too_large" and not any(r["status"] == "error" for r in found.values())
    assert found[3]["text"] == "deep" and "bold" in found[4]["text"] and "x" in found[5]["text"] and "x" in found[14]["text"]
    assert html.page_parts(pages.limit(0)).count() == 0


def test_what_fails_is_a_row(spark, monkeypatch):
    def fail(text):
        raise RuntimeError(text)

    monkeypatch.setattr(html, "Page", fail)
    assert html.page_fields("<p>x</p>")[0] == "error"


def test_time_grows_with_the_page():
    import time

    def seconds(depth):
        began = time.perf_counter()
        for made in ("<div><a href=/x>a link with a label</a> text ", "<section><p>words of a paragraph</p>", "<blockquote><p>q</p>", "<b>bold "):
            html.page_fields("<main>" + made * depth + "end")
        return time.perf_counter() - began

    seconds(50)
    assert seconds(2400) < 40 * max(seconds(150), 0.02)


def test_next_data_in_key_order():
    page = html.Page('<script id="__NEXT_DATA__">{"b": "second sentence of the page", "a": ["first sentence of the page"]}</script>')
    assert page.state() == "first sentence of the page\nsecond sentence of the page"
    assert html.Page('<script id="__NEXT_DATA__">{broken</script>').state() == ""


def test_stream_dedup(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"ts":"2024-01-01T00:00:00Z","url":"https://a.x/?utm_id=1"}\n{"ts":"2024-01-01T00:01:00Z","url":"https://a.x/"}\n')
    stream = spark.readStream.schema("ts timestamp, url string").json(str(tmp_path / "in"))
    log.append_log(log.visited_once(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_forum_order():
    page = """<div class=post><p>ask</p></div><div class="post"><span class=score>3</span><p>low</p></div>
<div class="post accepted"><span class=score>1</span><p>best</p></div><div class=post><span class=score>1.2k</span><p>high</p></div>
<div class=post><span class=score>none</span><i itemprop="upvoteCount">+7</i><p>seven</p></div>"""
    text = html.Page(page).forum()
    assert text.index("ask") < text.index("[Score: 1] (Accepted Answer)\n\n\n\nbest") < text.index("[Score: 12]") < text.index("[Score: 7]") < text.index("[Score: 3]")
    assert html.Page("<p>none</p>").forum() == ""


def test_charsets():
    assert html.decode("日本".encode("shift_jis"), "text/html; charset=Shift_JIS") == "日本"
    assert html.decode(b'<meta charset="latin1">\xe9').endswith("é")
    assert html.decode(b"\xef\xbb\xbfa\xff", "text/html; charset=nonsense") == "a\ufffd"
    assert html.decode("é".encode("utf-16-le"), "text/html; charset=utf-16le") == "é"
    assert html.decode(b"\xff\xfe" + "é".encode("utf-16-le"), "text/html; charset=utf-8") == "é"


def test_result_pages():
    lite = '<a href="/settings">s</a><a class=result-link href="https://a.x/1">One</a><a class="x result-link" href="/l/?uddg=https%3A%2F%2Fb.x%2Fa%20b%3Fc%3D1&rut=z"> Two </a><a class=result-link href="https://a.x/1">again</a><a class=result-link href="/l/?x=1">none</a><a class=result-link href="https://c.x"></a>'
    assert html.result_links(lite, 9) == [("https://a.x/1", "One"), ("https://b.x/a b?c=1", "Two")]
    assert html.result_links(lite, 1) == [("https://a.x/1", "One")]
    assert html.result_links('<a href="https://a.x/">A</a>', 5) == [("https://a.x/", "A")] and html.result_links("", 5) == []


def test_body_cache_from_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("2024-01-01T00:00:00Z", "https://a.x/?utm_id=1", "first"), ("2024-01-01T00:20:00Z", "https://a.x/", "late"), ("2024-01-01T00:30:00Z", "https://b.x/", "other")]
    (tmp_path / "in/a.json").write_text("\n".join(f'{{"ts":"{t}","url":"{u}","body":"{b}"}}' for t, u, b in rows))
    stream = spark.readStream.schema("ts timestamp, url string, body string").json(str(tmp_path / "in"))
    log.store_bodies(log.fresh_bodies(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["body"] for r in log.read_bodies(spark, str(tmp_path / "out")).collect()) == ["first", "other"]


def test_requests_per_host(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"ts":"2024-01-01T00:00:00Z","url":"https://a.x/1"}\n{"ts":"2024-01-01T00:01:00Z","url":"https://A.x/2"}\n{"ts":"2024-01-01T02:00:00Z","url":"https://b.x/"}\n')
    stream = log.requests_per_host(spark.readStream.schema("ts timestamp, url string").json(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("per_host").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {(r["host"], r["n"]) for r in spark.table("per_host").collect()} == {("a.x", 2), ("b.x", 1)}


def test_question_files(spark, tmp_path):
    import pytest

    from loomweb.sources import evals

    (tmp_path / "q.jsonl").write_text('{"question":"a","url":"https://a.x"}\n\n{"question":"b"}\n')
    with pytest.raises(ValueError):
        evals.load_questions(spark, str(tmp_path / "q.parquet"))
    with pytest.raises(Exception, match="no source_url"):
        evals.load_questions(spark, str(tmp_path / "q.jsonl")).collect()
    table = spark.createDataFrame([("what?\n\nReference URLs:\n- https://a.x/1",)], "question string")
    evals.convert_questions(table, str(tmp_path / "made.jsonl"))
    assert [tuple(r) for r in evals.load_questions(spark, str(tmp_path / "made.jsonl")).collect()] == [("what?", "https://a.x/1", "")]


def test_tuning_moves_the_objective(spark):
    rows = [(1, "a", 0, 0, "https://x.com/1", "t", None), (1, "a", 0, 1, "https://docs.rs/gold", "t", None), (1, "a", 0, 2, "https://medium.com/what-is-it", "t", None)]
    lists, queries = spark.createDataFrame(rows, LIST), spark.createDataFrame([(1, "zz")], "query_id long, query string")
    objective = evaluate.tuning_objective(lists, queries, spark.createDataFrame([(1, "https://docs.rs/gold")], "query_id long, gold_url string"))
    names = ("domain_trust", "domain_diversity", "snippet_relevance", "url_pattern", "blocklist_penalty", "project_match")
    start = dict.fromkeys(names, 0.0) | {"rrf_k": 60.0}
    assert objective(start) == 0.5
    best = evaluate.coordinate_ascent(objective, start, 0.5, 1)
    assert objective(best) == 1.0


def test_nearest_snapshots_over_hours_and_ties(spark):
    import datetime
    import random

    rng = random.Random(3)
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    wanted = [(n, f"k{rng.randrange(4)}", at(rng.randrange(0, 6000, 5))) for n in range(200)] + [(200, "none", at(0))]
    seen = [(f"k{rng.randrange(4)}", at(rng.randrange(0, 6000, 5)), f"s{n:03}") for n in range(60)]
    from loomweb.sources import adapters

    found = adapters.nearest_snapshots(spark.createDataFrame(wanted, "n int, key string, at timestamp"), spark.createDataFrame(seen, "key string, ts timestamp, id string"))
    want = {n: min(((abs(t - a), t, i) for k, t, i in seen if k == key), default=(None, None, None))[1:] for n, key, a in wanted}
    assert {r["n"]: (r["nearest"], r["nearest_id"]) for r in found.collect()} == want
