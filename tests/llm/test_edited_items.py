import numpy as np
import pytest

from loomweb.llm import decontaminate

from .helpers import docs


@pytest.mark.parametrize("n_words", [12, 20, 28, 60])
def test_edited_items_are_found(spark, n_words):
    rng = np.random.default_rng(n_words)
    words = [[f"v{i}" for i in rng.permutation(400)[:n_words]] for _ in range(20)]  # all items share a vocabulary
    text = lambda w: " ".join(w[: len(w) // 2]) + "? " + " ".join(w[len(w) // 2 :])
    items = spark.createDataFrame([(n, text(w)) for n, w in enumerate(words)], "item_id long, text string")
    texts = []
    for n, w in enumerate(words):
        edited = [*w]
        for at in (n_words // 3, 3 * n_words // 4)[: 1 + n % 2]:
            edited[at] = "changed"
        texts.append("some words before " + text(edited) + " and after")
        texts.append(" ".join(rng.permutation(w)))  # the same words, another text
    want = {(2 * n, n) for n in range(len(words))}
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs(spark, texts), items).collect()}
    assert found == want


def test_parts_change_no_score(spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"v{i}" for i in rng.zipf(1.5, rng.integers(6, 60)) % 300) for _ in range(30)]
    items = spark.createDataFrame([*enumerate(texts), (30, ""), (31, None)], "item_id long, text string")
    rows = [f"before {t} after" for t in texts] + [" ".join(t.split()[: len(t.split()) * 3 // 4]) for t in texts]
    frame = docs(spark, rows)
    get = lambda: sorted(tuple(r) for r in decontaminate.leaks(frame, items).collect())
    whole = get()
    monkeypatch.setattr(decontaminate, "PART_BYTES", 4096)
    assert get() == whole and len(whole) >= 30
