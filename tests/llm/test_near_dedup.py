import numpy as np
import pytest

from loomweb.llm import decontaminate, simhash

from .helpers import DOCS, docs


def shingle_set(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(texts):
    """The smallest index that links reach, by comparing all pairs."""
    sets = [shingle_set(t) for t in texts]
    fps = [simhash.fingerprint(simhash.shingle_hashes(t.lower().encode().split(), 5)) for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if bin(fps[a] ^ fps[b]).count("1") <= 3 or 10 * common >= 8 * (len(sets[a]) + len(sets[b]) - common) > 0:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    return label


def edited(rng, n, places):
    words = [f"w{i}" for i in rng.integers(0, 10**9, n)]
    return " ".join(words), " ".join(f"e{i}" if i in places else w for i, w in enumerate(words))


@pytest.mark.parametrize("members", [4, 512])
def test_similarity_is_exact_at_the_bar(spark, monkeypatch, members):
    monkeypatch.setattr(simhash, "MEMBERS", members)
    monkeypatch.setattr(simhash, "MET", members)
    rng = np.random.default_rng(5)
    texts = []
    for n in range(48 - 8, 49 + 8):  # with 49 words, one changed word leaves 40 of 50 shingles: 0.8
        for _ in range(3):
            texts += edited(rng, n, {20})
    base = [f"b{i}" for i in range(100)]
    for k in range(20):  # a family whose members link only through some of the others
        at = set(rng.choice(range(5, 95), 1 + k % 3, replace=False).tolist())
        texts.append(" ".join(f"f{k}x{i}" if i in at else w for i, w in enumerate(base)))
    kept = {r["doc_id"] for r in simhash.keep_one(docs(spark, texts, True)).collect()}
    assert kept == set(groups(texts))


def test_null_and_repeated_ids(spark):
    rng = np.random.default_rng(7)
    a, near_a = edited(rng, 200, {100})
    other = [edited(rng, 60, set())[0] for _ in range(6)]
    rows = [
        (1, a), (2, near_a), (2, other[0]),  # the near copy goes, the other text with its id stays
        (None, other[1]), (None, other[2]), (None, near_a), (None, other[1]),  # documents without an id are documents
        (None, other[3]), (None, other[3] + " more"),  # a group without any id keeps one
        (4, other[4]), (4, other[4]), (4, other[5]), (5, None), (6, ""),
    ]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_one(frame).collect()]
    loose = [x for x in kept if x in ((None, other[3]), (None, other[3] + " more"))]
    assert len(loose) == 1
    key = lambda x: (str(x[0]), str(x[1]))
    want = [(1, a), (2, other[0]), (None, other[1]), (None, other[2]), (4, other[4]), (4, other[5]), (5, None), loose[0]]
    assert sorted(kept, key=key) == sorted(want, key=key)


def test_clean_keeps_other_texts_of_an_id(spark):
    item = "Which river crosses the old northern valley before reaching the sea? The answer is the silent green river of stones"
    items = spark.createDataFrame([(0, item)], "item_id long, text string")
    rows = [(None, item), (None, "one clean text"), (None, None), (3, f"so {item}"), (3, "other clean text"), (4, "third clean text")]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    left = {(r["doc_id"], r["text"]) for r in decontaminate.clean(frame, items).collect()}
    assert left == {(None, "one clean text"), (None, None), (3, "other clean text"), (4, "third clean text")}
