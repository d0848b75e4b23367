"""The corpus pipeline against a brute-force version of its stages, on a small corpus with planted cases."""

import hashlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from loomweb.llm import queries, quality

from .helpers import DOCS
from .test_near_dedup import groups
from .test_text_operators import brute_leaks, js


def corpus():
    rng = np.random.default_rng(21)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnoprstuvw"), int(rng.integers(2, 9)))) for _ in range(4000)]
    word = lambda n: " ".join(str(w) for w in rng.choice(vocabulary, n))
    items = [word(12) + "? " + word(14) for _ in range(6)]
    texts = [word(int(rng.integers(40, 160))) for _ in range(30)]
    passage = word(60)
    texts += [word(30) + " " + passage + " " + word(int(rng.integers(30, 60))) for _ in range(4)]  # a passage that documents share
    texts += [texts[0], texts[0], texts[1] + " one more end"]  # copies, and a near one
    near = texts[2].split()
    near[20] = "edited"
    texts.append(" ".join(near))
    texts += [word(40) + " " + items[n] + " " + word(40) for n in range(3)]  # benchmark passages
    edited = items[3].split()
    edited[5] = "edited"
    texts.append(word(30) + " " + " ".join(edited) + " " + word(30))
    texts += ["too short", "", None, " ".join([word(9)] * 8), " ".join(w + "$$###" for w in word(60).split())]  # what the rules reject
    rows = [(n, t, "en" if n % 3 else "xx", "s", len(t or "")) for n, t in enumerate(texts)]
    rows.append((None, word(70), "en", "s", 1))  # no id
    rows.append((3, word(70), None, "s", 1))  # another text under an id that is there
    return rows, items


def brute_kept(rows):
    measured = []
    for _, text, lang, _, _ in rows:
        w = (text or "").split()
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
        joined = "".join(w)
        symbols = sum(c in "#*$%&|<>" for c in joined)
        marks = sum(c in ".,;:!?'\"()-" for c in joined)
        other = [sum(c.isascii() and c.isupper() for c in joined), sum(c.isascii() and c.isdigit() for c in joined), marks, symbols]
        wide = sum(ord(c) > 127 for c in joined)
        classes = [*other, len(joined) - wide - sum(other), wide]
        own = quality.COMMON.get(lang)
        common = [sum(x == c for x in w) / max(1, len(w)) for c in own] if own else None
        measured.append((lang, len(w), len(w) < 20 or 100 * len(covered) > 30 * len(w), [c / max(1, len(joined)) for c in classes], [*common, 1 - sum(common)] if own else None))
    out = []
    for row, (lang, n, failed, p, c) in zip(rows, measured):
        peers = [m for m in measured if m[0] == lang and not m[2]]
        one = [m[3] for m in peers if m[1] >= quality.MIN_CLASS_WORDS]
        two = [m[4] for m in peers if m[1] >= quality.MIN_COMMON_WORDS and m[4]]
        far = n >= quality.MIN_CLASS_WORDS and one and js(p, np.mean(one, axis=0)) > quality.MAX_CLASS_DISTANCE
        far = far or (n >= quality.MIN_COMMON_WORDS and c and two and js(c, np.mean(two, axis=0)) > quality.MAX_COMMON_DISTANCE)
        if not failed and not far:
            out.append(row)
    return out


def brute_one_each(rows):
    different = sorted({(r[0] is None, r[0], r[1]) for r in rows}, key=lambda k: (k[0], k[1] or 0, k[2]))
    label = groups([k[2] for k in different])
    first = {different[at] for at in label}
    seen, out = set(), []
    for r in rows:
        key = (r[0] is None, r[0], r[1])
        if key in first and key not in seen:
            seen.add(key)
            out.append(r)
    return out


def brute_without_repeats(rows):
    raws = [r[1].encode() for r in rows]
    seen = Counter(t[i : i + 200] for t in raws for i in range(len(t) - 199))
    out = []
    for r, raw in zip(rows, raws):
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 199):
            if seen[raw[i : i + 200]] > 1:
                gone[i : i + 200] = True
        out.append((r[0], bytes(b for b, g in zip(raw, gone) if not g).decode(errors="ignore"), *r[2:]))
    return out


def test_pipeline_by_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, items = corpus()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = brute_kept(rows)
    ones = brute_one_each(kept)
    bare = brute_without_repeats(ones)
    leaks = {d for d, *_ in brute_leaks([r[1] for r in bare], items)}
    left = [r for n, r in enumerate(bare) if n not in leaks]
    assert len(rows) > len(kept) > len(ones) > len(left) and sum(len(a[1]) - len(b[1]) for a, b in zip(ones, bare)) > 1000 and len(leaks) == 4
    library = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    want = []
    for own, text, *_ in left:
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((str(own), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    found = [(str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(want)
    # clean documents, those without an id and those under a repeated one, are all there
    ids = defaultdict(int)
    for f in found:
        ids[f[0]] += 1
    assert ids["None"] == 1 and ids["3"] == 2 and {str(n) for n in range(30)} <= set(ids)


def test_stages_keep_their_columns(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame([*enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
