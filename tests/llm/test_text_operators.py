import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from loomweb.llm import bpe, decontaminate, license_scan, quality, queries, simhash, suffix_dedup, token_counts

from .helpers import DOCS, ODD, by_id, docs

LOWER = {i: i + 32 for i in range(65, 91)}


def test_license_places(spark):
    texts = [*ODD, "Under the MIT\nLicense; under THE mit license", "Apache License, Version 2.0", "CC-BY-NC cc by nc", "mit under the license", "word " * 200 + "Released under the MIT License."]
    found = by_id(license_scan.license_matches(docs(spark, texts, True)))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for n, text in enumerate(texts):
        w = word.findall((text or "").translate(LOWER))
        want = sorted((s, label) for p, label in license_scan.PHRASES for s in range(len(w)) if w[s : s + len(p.split())] == p.split())
        assert (found[n]["n_words"], sorted((p["first"], p["label"]) for p in found[n]["places"])) == (len(w), want)


def test_license_join_is_exact():
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}".encode() for i in range(30)]
    found = [license_scan.Template(tuple(rng.choice(vocabulary, n)), f"t{n}", 0.6, False) for n in (1, 8, 8, 8, 32, 33, 70)]
    frequency = {w: int(rng.integers(1, 99)) for w in vocabulary}
    index = license_scan.PrefixIndex(found, frequency)
    words = [bytes(w) for w in rng.choice([*vocabulary, *(b"o%d" % i for i in range(150))], 700)]
    got = {(label, start) for label, start, _ in index.scan(words)[1]}
    stride = {1: 32, 8: 32, 32: 32, 33: 64, 70: 128}
    want = {(t.label, s) for t in found for s in range(0, 700, stride[len(t.words)]) if len(set(t.words) & set(words[s : s + 2 * stride[len(t.words)]])) >= t.need}
    assert got == want and len(want) > 10


def test_license_texts_are_found(spark):
    rng = np.random.default_rng(2)
    filler = lambda n: " ".join(f"f{i}" for i in rng.integers(0, 10**6, n))
    texts, want = [*ODD], []
    for text, label in license_scan.NOTICES:
        for edited in (0.0, 0.1):
            words = text.split()
            for at in rng.choice(len(words), int(edited * len(words)), replace=False):
                words[at] = f"x{at}"
            want.append((len(texts), label))
            texts.append(f"{filler(int(rng.integers(0, 300)))} {' '.join(words)} {filler(int(rng.integers(0, 300)))}")
    clean = len(texts)
    texts += [filler(500) for _ in range(20)]
    found = by_id(license_scan.license_matches(docs(spark, texts, True)))
    assert [(n, label) for n, label in want if label not in {b["label"] for b in found[n]["blocks"]}] == []
    assert not any(found[n]["blocks"] for n in [*range(len(ODD)), *range(clean, len(texts))])
    assert license_scan.license_matches(docs(spark, [])).count() == 0


def test_license_query_by_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    notices = [t for t, _ in license_scan.NOTICES]
    pool = [w for t in notices for w in t.split()] + [f"o{i}" for i in range(40)]
    texts = [*ODD, "Under the MIT license; CC BY NC", "apache license, version 2 cc by nc under the mit license"]
    texts += [" ".join(rng.choice(pool, int(rng.integers(1, 400)))) + " " + str(rng.choice(notices)) for _ in range(30)]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    found = by_id(queries.op1_license_scan(spark, str(tmp_path)))
    for n, text in enumerate(texts):
        w = license_scan.words_of((text or "").encode())
        base = [(s, label) for p, label in license_scan.PHRASES for s in range(len(w)) if b" ".join(w[s : s + len(p.split())]) == p.encode()]
        blocks = []
        for t, label in license_scan.NOTICES:
            own = set(license_scan.words_of(t.encode()))
            size = max(32, 1 << (len(license_scan.words_of(t.encode())) - 1).bit_length())
            for s in range(0, len(w), size):
                share = len(own & set(w[s : s + 2 * size])) / len(own)
                blocks += [(label, share)] if 10 * len(own & set(w[s : s + 2 * size])) >= 8 * len(own) else []
        starts = [s for s, _ in base] or [None]
        want = (len(w), len(base), min(starts), max(starts), ",".join(sorted({x for _, x in base})), ",".join(sorted({x for _, x in base} | {x for x, _ in blocks})))
        r = found[n]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) == want
        assert abs(r["score"] - (1.0 if base else max([x for _, x in blocks], default=0.0))) < 1e-12


def test_repeats_by_brute_force():
    rng = np.random.default_rng(3)
    for size, core, letters in ((5, 2, 2), (8, 3, 2), (8, 8, 2), (20, 5, 3)):
        keys, rows = [], []
        for key in range(6):  # what is common stands at one place of each segment
            common = bytes(rng.integers(97, 97 + letters, core).astype(np.uint8))
            for _ in range(rng.integers(1, 9)):
                left, right = (bytes(rng.integers(97, 97 + letters, rng.integers(0, size - core + 1)).astype(np.uint8)) for _ in "ab")
                if len(left) + len(right) >= size - core:
                    keys.append(key)
                    rows.append((left + common + right, len(left)))
        seen = Counter((k, s[i : i + size], at - i) for k, (s, at) in zip(keys, rows) for i in range(len(s) - size + 1))
        sizes, ats = np.array([len(s) for s, _ in rows]), np.array([at for _, at in rows])
        got = list(zip(*suffix_dedup.repeated_starts(np.array(keys), sizes, np.frombuffer(b"".join(s for s, _ in rows), np.uint8), ats, core, size)))
        for n, (k, (s, at)) in enumerate(zip(keys, rows)):
            want = [i for i in range(len(s) - size + 1) if seen[k, s[i : i + size], at - i] > 1]
            assert [i for who, a, z in got if who == n for i in range(a, z + 1)] == want


def test_halves_deal_every_string_once():
    rng = np.random.default_rng(4)
    for _ in range(300):
        core = int(rng.integers(1, 20))
        at, tail = int(rng.integers(0, 20 - core + 1)), int(rng.integers(0, 20 - core + 1))
        piece = bytes(rng.integers(97, 99, max(20, at + core + tail)).astype(np.uint8))[: max(20, at + core + tail)]
        if len(piece) - at > 20:
            continue
        dealt = [start + i for start, place, size, part in suffix_dedup.halves(piece, at, core, 20) for i in range(len(part) - 19)] if core < 20 else list(range(len(piece) - 19))
        assert sorted(dealt) == list(range(len(piece) - 19))
        for start, place, size, part in suffix_dedup.halves(piece, at, core, 20) if core < 20 else ():
            assert core < size <= 20 and part == piece[start : start + len(part)] and place <= 20 - size and len(part) - place <= 20


def test_runs_cover_every_start_once(monkeypatch):
    raw = np.random.default_rng(5).integers(97, 101, 3000).astype(np.uint8)
    whole = suffix_dedup.runs(raw)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 700)
    for _, _, first, last in (whole, suffix_dedup.runs(raw)):
        assert np.concatenate([np.arange(a, z + 1) for a, z in zip(first, last)]).tolist() == list(range(2801))


@pytest.mark.parametrize("most", [256 << 10, 6000])
def test_repeat_report(spark, most):
    rng = np.random.default_rng(8)
    piece = lambda n: "".join(chr(c) for c in rng.integers(97, 123, n))
    shared, long, line = piece(230), piece(420), piece(150)
    texts = [*ODD, piece(100) + shared + piece(90), shared[:210] + piece(300), "é" + shared[10:], long, long, piece(50) + long[100:] + shared[5:], shared[:199], "ab" * 300]
    texts += [piece(60) + line + piece(60) for _ in range(40)] + [piece(60) + line + shared[:55] for _ in range(9)]  # one anchor, many contexts
    report = by_id(suffix_dedup.repeat_report(docs(spark, texts, True), most=most))
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    for n, raw in enumerate(raws):
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - 199):
            if seen[raw[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        want = {"doc_id": n, "n_bytes": len(raw), "n_removed": int(gone.sum()), "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest()}
        assert report[n] == want, n
    rest = by_id(suffix_dedup.without_repeats(docs(spark, texts, True), most=most))
    assert rest[0]["text"] is None and rest[12]["text"] == "" and len(rest[9]["text"]) == 190


def test_token_counts(spark):
    import sentencepiece

    path = queries.tokenizer_file("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*ODD, " a  b\n\n c\td </s> ▁x ▁", "\n", " ", "日本語" * 50, "a" * 20000]
    frame = docs(spark, texts, True)
    found = [(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(frame.unionByName(frame), path, 10).collect()]
    want = [(n, len((t or "").encode()), k := len(model.encode(t or "")), k > 10) for n, t in enumerate(texts)]
    assert sorted(found) == sorted(want * 2)
    assert token_counts.token_counts(frame.limit(0), path).count() == 0


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [*ODD, "<|startoftext|>Hi<|endoftext|> <|STARTOFTEXT|>", "ΑΣ İI ǅ é \x1c\x1d a\u0085b\xa0c ½²", "hahaha" * 30, "it's we'LL", "aaaa" * 99]
    found = by_id(bpe.encode_decode(docs(spark, texts, True), path, with_ids=True))
    for n, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert found[n]["ids"] == ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (found[n]["n_tokens"], found[n]["decoded"]) == (len(ids), decoded)
        assert found[n]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[n]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def reach(fps: list[int], distance: int) -> list[int]:
    label = list(range(len(fps)))
    for _ in fps:
        for a in range(len(fps)):
            label[a] = min(label[b] for b in range(len(fps)) if bin(fps[a] ^ fps[b]).count("1") <= distance)
    return label


def test_fingerprint_and_components(spark):
    import xxhash

    base = "one two three four five six seven eight nine ten " * 9
    texts = [*ODD, base, base + "eleven", base.upper(), base.replace("six", "6"), "completely different words here now"]
    found = by_id(simhash.simhash_components(docs(spark, texts, True)))

    def fp(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
        pieces = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    want = [fp(t or "") for t in texts]
    assert [found[n]["fp"] % (1 << 64) for n in range(len(texts))] == want
    assert [found[n]["component_id"] for n in range(len(texts))] == reach(want, 3)
    assert simhash.simhash_components(docs(spark, []), "doc_id").count() == 0
    kept = by_id(simhash.keep_one(docs(spark, texts, True)))
    assert {9, 13} <= set(kept) and 11 not in kept and kept[9]["text"] == base


def test_near_copies_link_and_others_stay(spark):
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 400)]
    near = [*base]
    for at in (50, 150, 250, 350):
        near[at] = "changed"
    far = [*base]
    for at in range(0, 400, 8):
        far[at] = f"other{at}"
    clean = [" ".join(f"c{i}" for i in rng.integers(0, 10**6, 200)) for _ in range(20)]
    frame = docs(spark, [" ".join(base), " ".join(near), " ".join(far), *clean, *ODD[3:]], True)
    kept = {r["doc_id"] for r in simhash.keep_one(frame).collect()}
    assert 0 in kept and 1 not in kept and {2, *range(3, 23)} <= kept


@pytest.mark.parametrize("direct", [8, 1024])
def test_links_lose_nothing(direct, monkeypatch):
    monkeypatch.setattr(simhash, "DIRECT", direct)
    rng = np.random.default_rng(direct)
    fps = rng.integers(0, 1 << 63, 3, dtype=np.uint64)[rng.integers(0, 3, 90)]
    for _ in range(3):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 30, 90).astype(np.uint64))
    fps = np.unique(fps)
    i, j = simhash.linked(fps, 3, simhash.pivots())
    label = list(range(len(fps)))
    for a, b in sorted(zip(i.tolist(), j.tolist())):
        label[a] = label[b]
    assert label == reach([int(x) for x in fps], 3)


def test_key_masks_cover_pairs():
    rng = np.random.default_rng(2)
    for n in (10, 1 << 22, 1 << 30):
        masks = simhash.key_masks(3, n)
        for _ in range(50):
            flipped = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
            assert any(not flipped & m for m in masks)


def test_quality_counts(spark):
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    texts = [*ODD, f"{line}\n{line}\n \n{line} x", "a # b * c $ d " * 3, " ".join(f"w{i}" for i in range(60))]
    found = {r["doc"]["doc_id"]: r for r in quality.judge(docs(spark, texts, True)).collect()}
    for n, text in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        r = found[n]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality.keep(docs(spark, texts, True)).columns == docs(spark, texts, True).columns


def test_divergence_rejects_symbols(spark):
    clean = ["the of and to in a is that for it was on with this word " * 1 + " ".join(f"common{i}" for i in range(k, k + 40)) for k in range(40)]
    junk = " ".join(f"a{i}$$$" for i in range(60))
    kept = {r["doc_id"] for r in quality.keep(docs(spark, [*clean, junk])).collect()}
    assert kept == set(range(40))


def test_decontamination(spark):
    item = "Which river crosses the old northern valley before reaching the sea? The answer is the silent green river of stones"
    items = spark.createDataFrame([(0, item), (1, "completely other question about cooking soup with many herbs and roots inside"), (2, ""), (3, None)], "item_id long, text string")
    filler = " ".join(f"filler{i}" for i in range(300))
    texts = [*ODD, f"{filler} {item.upper()} {filler}", item.replace("silent", "loud"), "Which river crosses the old northern valley before reaching the sea?", filler, f"{filler} {item}", item]
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs(spark, texts, True), items).collect()}
    n = len(ODD)
    assert {(n, 0), (n + 4, 0), (n + 5, 0)} <= found <= {(n, 0), (n + 1, 0), (n + 4, 0), (n + 5, 0)}
    left = {r["doc_id"] for r in decontaminate.clean(docs(spark, texts, True), items).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in found}
    assert decontaminate.leaks(docs(spark, texts), items.limit(0)).count() == 0


@pytest.mark.parametrize(("short", "few"), [(0, 1), (2, 3), (64, 16)])
def test_search_equals_all_scores(short, few, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHORT", short)
    monkeypatch.setattr(decontaminate, "FEW", few)
    rng = np.random.default_rng(4)
    words = [f"v{i}" for i in range(60)]
    index = decontaminate.Index([(i, " ".join(rng.choice(words, rng.integers(5, 20)))) for i in range(50)])
    hits = 0
    for _ in range(60):
        terms = rng.permutation(len(index.term))[: rng.integers(1, 40)]
        scores = np.zeros(50)
        for t in terms:
            scores[index.numbers[index.start[t] : index.start[t + 1]]] += index.weights[index.start[t] : index.start[t + 1]]
        assert [i for i, _ in sorted(index.search(terms))] == np.flatnonzero(scores >= decontaminate.THRESHOLD).tolist()
        hits += (scores >= decontaminate.THRESHOLD).sum()
    assert hits > 100


def brute_leaks(texts, items):
    """(doc, item, score, overlap, first word) by scoring every piece against every passage."""
    words = [license_scan.words_of((t or "").encode()) for t in items]
    pieces = [(n, p) for n, w in enumerate(words) for p in decontaminate.pieces_of(w)]
    df = Counter(w for _, p in pieces for w in set(p))
    mean = sum(len(p) for _, p in pieces) / len(pieces)

    def weights(p):
        tf = Counter(p)
        each = {w: np.log(1 + (len(pieces) - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(p) / mean)) for w, f in tf.items()}
        return {w: x / sum(each.values()) for w, x in each.items()}

    weighed = [(n, weights(p)) for n, p in pieces]
    index = decontaminate.Index(list(enumerate(items)))
    number = {i: k for k, (i, _) in enumerate(index.items)}
    out = []
    for d, text in enumerate(texts):
        w = license_scan.words_of((text or "").encode())
        best = {}
        for low in range(-64, len(w), 64):
            passage = set(w[max(0, low) : low + 128])
            top = {}
            for n, each in weighed:
                score = sum(x for t, x in each.items() if t in passage)
                if score >= 0.5 - 1e-12:
                    top[n] = max(top.get(n, 0), score)
            for n, score in top.items():
                overlap = index.verify(number[n], w[max(0, max(0, low) - len(words[n])) : low + 128 + len(words[n])])
                if overlap is not None:
                    best[n] = max(best.get(n, (0.0, 0.0, 0)), (overlap, round(score, 6), -max(0, low)))
        out += [(d, n, score, round(overlap, 9), -low) for n, (overlap, score, low) in best.items()]
    return sorted(out)


@pytest.mark.parametrize("part_bytes", [32 << 20, 6000])
def test_leaks_are_all_pairs(spark, part_bytes, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_BYTES", part_bytes)
    rng = np.random.default_rng(12)  # fixed, so both runs hold against the same rows
    word = lambda n, k=300: " ".join(f"v{i}" for i in rng.zipf(1.3, n) % k)
    items = [word(n) + "? " + word(m) for n, m in rng.integers(3, 60, (24, 2))] + [word(700), "", None, "one", word(40)]
    texts = [*ODD, word(900)]
    for t in items[:25]:
        texts.append(word(int(rng.integers(0, 200))) + " " + t + " " + word(int(rng.integers(0, 200))))
        kept = t.split()
        for at in rng.integers(0, len(kept), 1 + len(kept) // 9):
            kept[at] = "changed"
        texts.append(" ".join(kept))
        texts.append(" ".join(t.split()[: len(t.split()) * 2 // 3]))
    frame = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    found = decontaminate.leaks(docs(spark, texts, True), frame).collect()
    got = sorted((r["doc_id"], r["item_id"], round(r["score"], 6), round(r["overlap"], 9), r["first_word"]) for r in found)
    want = brute_leaks(texts, items)
    assert [x[:2] for x in got] == [x[:2] for x in want] and len(want) >= 50
    assert np.allclose(np.array(got)[:, 2:], np.array(want)[:, 2:], atol=2e-6)


def js(p, q):
    term = lambda a, b: a * np.log2(2 * a / (a + b)) if a > 0 else 0.0
    return max(0.0, sum(0.5 * term(a, b) + 0.5 * term(b, a) for a, b in zip(p, q))) ** 0.5


def test_quality_verdicts_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quality, "MIN_COMMON_WORDS", 40)
    rng = np.random.default_rng(13)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzéüß日本ABC019.,!$#"), int(rng.integers(2, 9))))
    rows = []
    for n in range(160):
        lang = [None, "xx", "en", "de", "fr"][n % 5]
        common = quality.COMMON.get(lang, ["uno"])
        k, share = int(rng.integers(0, 90)), rng.random()
        words = [str(rng.choice(common)) if rng.random() < share else word() for _ in range(k)]
        if n % 11 == 0:
            words = [w + "$$$###" for w in words]
        if n % 13 == 0:
            words = words[:12] * 4
        rows.append((n, " ".join(words) if n % 17 else None, lang, "s", 1))
    rows.append((160, " ".join(f"w{i}" for i in range(60)), "solo", "s", 1))
    measured = {}
    for n, text, lang, _, _ in rows:
        w = (text or "").split()
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
        joined = "".join(w)
        classes = [len(re.findall(c, joined)) for c in ("[A-Z]", "[0-9]", "[.,;:!?'\"()-]", "[#*$%&|<>]")]
        wide = sum(ord(c) > 127 for c in joined)
        classes += [len(joined) - wide - sum(classes), wide]
        p_class = [c / len(joined) if joined else 0.0 for c in classes]
        own = quality.COMMON.get(lang)
        p_common = [sum(x == c for x in w) / len(w) if w else 0.0 for c in own] if own else None
        p_common = [*p_common, max(0.0, 1 - sum(p_common))] if own else None
        measured[n] = (lang, len(w), len(w) < 20 or 100 * len(covered) > 30 * len(w), p_class, p_common)
    found = {r["doc"]["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, DOCS), carry=["doc_id"]).collect()}
    rejected = 0
    for n, (lang, size, failed, p_class, p_common) in measured.items():
        peers = [m for m in measured.values() if m[0] == lang and not m[2]]
        mean = lambda k, least: np.mean([m[k] for m in peers if m[1] >= least], axis=0) if any(m[1] >= least for m in peers) else None
        q_class, q_common = mean(3, quality.MIN_CLASS_WORDS), mean(4, 40) if p_common else None
        d_class = js(p_class, q_class) if q_class is not None and size >= quality.MIN_CLASS_WORDS else None
        d_common = js(p_common, q_common) if q_common is not None and size >= 40 else None
        r = found[n]
        for got, want in ((r["class_distance"], d_class), (r["common_distance"], d_common)):
            assert (got is None) == (want is None) and (want is None or abs(got - want) < 1e-9), (n, lang)
        kept = not failed and (d_class or 0) <= quality.MAX_CLASS_DISTANCE and (d_common or 0) <= quality.MAX_COMMON_DISTANCE
        assert (r["base_failed"], r["kept"]) == (failed, kept)
        rejected += not failed and not kept
    assert rejected > 5 and found[160]["kept"]
    assert quality.judge(spark.createDataFrame([], DOCS)).count() == 0
