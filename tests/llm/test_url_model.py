import hashlib
import math
import random
from collections import Counter

import duckdb
import numpy as np

from loomweb.llm import url_filter

from .helpers import by_id


def brute(texts, labelled):
    """Scores by exact counts in dictionaries; labelled has (text, class)."""
    n, pad = url_filter.ORDERS, b"\0" * (url_filter.ORDERS - 1)
    grams, contexts = Counter(), Counter()
    for text, cls in labelled:
        t = pad + text
        for at in range(n - 1, len(t)):
            for k in range(n):
                grams[cls, t[at - k : at + 1]] += 1
                contexts[cls, t[at - k : at]] += 1

    def log_p(t, at, cls):
        p = 1 / 256
        for k in range(n):
            p = (grams[cls, t[at - k : at + 1]] + url_filter.WEIGHT * p) / (contexts[cls, t[at - k : at]] + url_filter.WEIGHT)
        return math.log(p)

    return [sum(log_p(pad + t, at, "allow") - log_p(pad + t, at, "block") for at in range(n - 1, len(t) + n - 1)) / max(1, len(t)) for t in texts]


def test_scores_are_of_exact_counts(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789-ü", k=60))
    urls = [f"http://{word()}.{'net/' if n % 2 else 'org/fr/'}{word()}" for n in range(400)]  # over 32,768 different windows
    urls += [f"http://{u[7:30]}.info/{word()[:9]}" for u in urls[:30]] + [None, "no scheme", "http://a.info"]
    rows = [(n, u) for n, u in enumerate(urls)] + [(None, urls[400]), (0, urls[401])]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    found = url_filter.judge_urls(frame.repartition(3))
    one = by_id(found.where("page_id > 0"), "page_id")
    text = lambda u: (u[7:] if u and "://" in u else "").lower().encode()
    labelled = [(text(u), "block" if n % 2 else "allow") for n, u in enumerate(urls[:400])]
    assert len({(t + b"\0" * 5)[i : i + 6] for t, _ in labelled for i in range(len(t))}) > 1 << 15
    held = lambda t: int(hashlib.md5(t).hexdigest()[:7], 16)
    fitted = [(t, c) for t, c in labelled if held(t) % url_filter.FOLDS]
    aside = [(t, c) for t, c in labelled if not held(t) % url_filter.FOLDS]
    assert {c for _, c in aside} == {"allow", "block"}
    histogram = np.zeros((2, url_filter.BINS))
    for (_, c), score in zip(aside, brute([t for t, _ in aside], fitted)):
        histogram[int(c == "block"), min(max(math.floor((score + url_filter.REACH) * url_filter.BINS / (2 * url_filter.REACH)), 0), url_filter.BINS - 1)] += 1
    cut = url_filter.cut_of(histogram)
    for n, want in zip(range(400, len(urls)), brute([text(u) for u in urls[400:]], fitted)):
        assert abs(one[n]["score"] - want) < 1e-9
        assert one[n]["verdict"] == ("block" if want < cut and text(urls[n]) else "allow")
    assert found.count() == len(rows) and one[1]["score"] is None


RULES_SQL = """with u as (select page_id, case when contains(url, '://') then regexp_replace(url, '^.*?://', '', 's') else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r(rule, own, start, what) as (values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow'))
select p.page_id, any_value(host) as host, any_value(path) as path, arg_max(rule, length(rule)) as rule, arg_max(what, length(rule)) as verdict
from p left join r on (host = own or ends_with(host, '.' || own)) and starts_with(path, start) group by 1"""


def test_rules_are_the_contract(spark):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = {r[0]: r[1:] for r in db.execute(RULES_SQL).fetchall()}
    found = by_id(url_filter.judge_urls(spark.read.parquet(f"{sf}/pages.parquet")), "page_id")
    assert len(found) == len(want)
    for n, (host, path, rule, verdict) in want.items():
        assert (found[n]["host"], found[n]["path"], found[n]["rule"]) == (host, path, rule)
        assert verdict in (None, found[n]["verdict"])
