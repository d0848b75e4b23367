import base64
import hashlib
import random

import duckdb

from loomweb.llm import chat, queries, url_filter, warc
from loomweb.llm.components import component_labels

from .helpers import by_id, missing

PAGES = "page_id long, url string, html string, refers_to string, file string"


def test_archives_round_trip(spark):
    htmls = ["<p>a</p>", None, "", "<p>a</p>", "ü" * 3000, "\r\n\r\nWARC/1.1\r\n\r\n", "<p>a</p>"]
    rows = [(10 - n, f"http://e.com/{n}\r\nX: y" if n else None, h, "z", "z") for n, h in enumerate(htmls)]
    folder, index = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3))
    found = by_id(warc.read_archives(folder, index, True), "page_id")
    for n, html in enumerate(htmls):
        raw, r = (html or "").encode(), found[10 - n]
        same = min(10 - k for k, h in enumerate(htmls) if (h or "") == (html or ""))
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if same == 10 - n else ("revisit", same))
        assert r["payload"] is None if same != 10 - n else bytes(r["payload"]) == raw
    some = warc.read_archives(folder, index.where("page_id in (9, 6)"))
    assert {r["page_id"] for r in some.collect()} == {9, 6}
    assert warc.write_archives(spark.createDataFrame([], PAGES))[1].count() == 0


def test_ranges_join_neighbours():
    places = [("f", 0, 10), ("f", 10, 5), ("f", 15 + warc.MAX_GAP, 5), ("f", 10_000_000, 5), ("g", 0, 5)]
    assert [(f, a, z, len(m)) for f, a, z, m in warc.ranges(places)] == [("f", 0, 20 + warc.MAX_GAP, 3), ("f", 10_000_000, 10_000_005, 1), ("g", 0, 5, 1)]


TURNS = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    nasty = "a <|turn|>user\n<|end|> %7C %25 [INST] </s> <<SYS>> % |> <|"
    rows = [(1, 0, "system", "be % kind"), (1, 1, "user", nasty), (1, 2, "assistant", nasty)]
    rows += [(1, k, "assistant" if k % 2 == 0 else "user", f"turn {k} " + "é" * 900) for k in range(3, 40)]
    rows += [(2, 0, None, None), (2, 0, None, None), (2, None, "assistant", "first"), (3, 5, "user\nx", "only")]
    made = chat.windows(spark.createDataFrame(rows, TURNS))
    found = by_id(chat.read_back(made), "conv_id")
    for conv in (1, 2, 3):
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert found[conv]["n_turns"] == len(turns)
        assert found[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        assert (found[conv]["loss_chars"], found[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    ones = sorted((r for r in made.collect() if r["conv_id"] == 1), key=lambda r: r["window"])
    assert len(ones) > 3 and all(r["formatted"].startswith("<|turn|>system\nbe %25 kind<|end|>") for r in ones)
    assert all(len(r["seqs"]) - sum(s >= r["first_seq"] for s in r["seqs"]) <= 3 for r in ones)
    assert chat.read_back(chat.windows(spark.createDataFrame([], TURNS))).count() == 0


def test_windows_keep_their_budget(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(40):
        rows += [(conv, 0, "system", "s" * rng.choice([10, 900]))] * (conv % 2)
        rows += [(conv, k, rng.choice(["user", "assistant"]), "x" * rng.choice([5, 400, 990, 1030, 3000])) for k in range(1, rng.randrange(2, 60))]
    rows.append((99, 1, "assistant", "y" * 9000))  # a lone turn over the budget
    made = chat.windows(spark.createDataFrame(rows, TURNS)).collect()
    text = {(c, n): (r, t) for c in {x[0] for x in rows} for n, (_, _, r, t) in enumerate(sorted(x for x in rows if x[0] == c))}
    seen = []
    for w in made:
        assert w["tokens"] <= chat.BUDGET or w["conv_id"] == 99
        new = [s for s in w["seqs"] if s >= w["first_seq"]]
        old = [s for s in w["seqs"] if s < w["first_seq"]]
        seen += [(w["conv_id"], s) for s in new]
        system = text[w["conv_id"], 0][0] == "system"
        assert (0 in w["seqs"]) or not system
        recent = [s for s in old if not (system and s == 0)]
        assert recent == list(range(w["first_seq"] - len(recent), w["first_seq"])) and len(recent) <= chat.HISTORY_TURNS
        assert len(w["loss_spans"]) == sum(text[w["conv_id"], s][0] == "assistant" for s in new)
        for span, s in zip(w["loss_spans"], [s for s in new if text[w["conv_id"], s][0] == "assistant"]):
            assert w["formatted"][span["start"] : span["start"] + span["length"]] == text[w["conv_id"], s][1]
    assert sorted(seen) == sorted(text)
    assert any(len([s for s in w["seqs"] if 0 < s < w["first_seq"]]) == 2 for w in made)


def test_sql_twins(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for name in ("pages", "conversations", "documents", "benchmark"):
        db.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        a, b = queries.queries()[name](spark, sf).toPandas(), db.execute(sql).df()
        cell = lambda v: "" if missing(v) else str(v) if isinstance(v, (bool, str)) else repr(round(float(v), 6))
        rows = lambda d: sorted(tuple(map(cell, r)) for r in d[sorted(d)].astype(object).itertuples(index=False))
        assert rows(a) == rows(b), name


def test_url_rules(spark):
    cases = [
        ("https://a.NET/x", "a.net", "/x", "net/", "block"), ("http://www.example.net/en/1?q", "www.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://example.com/de/#f", "example.com", "/de/", "example.com/de/", "block"), ("http://x.org/fr/a", "x.org", "/fr/a", "org/fr/", "allow"),
        ("http://notnet", "notnet", "", None, None), ("http://a.net", "a.net", "", None, None), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"),
        ("x://e.net?a://b/c", "e.net", "", None, None),
    ]
    rows = spark.createDataFrame([(n, c[0]) for n, c in enumerate(cases)], "page_id long, url string")
    found = by_id(url_filter.judge_urls(rows), "page_id")
    for n, (_, host, path, rule, verdict) in enumerate(cases):
        assert (found[n]["host"], found[n]["path"], found[n]["rule"]) == (host, path, rule)
        assert found[n]["verdict"] == verdict or verdict is None
    assert url_filter.judge_urls(rows.limit(0)).count() == 0


def test_url_model_tells_classes_apart(spark):
    rows = [(n, f"http://{'spam' if n % 2 else 'good'}{n}.{'net/buy' if n % 2 else 'org/fr/read'}/{n}") for n in range(200)]
    held = [(1000 + n, f"http://{'spam' if n % 2 else 'good'}{n}.info/{'buy' if n % 2 else 'read'}/{n}") for n in range(40)]
    found = by_id(url_filter.judge_urls(spark.createDataFrame(rows + held, "page_id long, url string")), "page_id")
    right = sum(found[1000 + n]["verdict"] == ("block" if n % 2 else "allow") for n in range(40))
    assert right >= 36


def test_components_by_union(spark):
    random.seed(1)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(None, 1), (7, 7)]
    label = {}

    def top(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = top(u), top(v)
            label[max(a, b)] = min(a, b)
    found = {r["id"]: r["label"] for r in component_labels(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: top(x) for x in label}
