"""Texts of several MB, empty tables, and rows that repeat, through every operator that reads texts."""

import hashlib

import numpy as np
import pytest

from loomweb.llm import bpe, decontaminate, license_scan, quality, queries, simhash, suffix_dedup, token_counts

from .helpers import by_id, docs


@pytest.fixture(scope="module")
def long_text():
    rng = np.random.default_rng(31)
    words = np.array(["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzé"), int(rng.integers(1, 9)))) for _ in range(5000)])
    return "\n".join(" ".join(words[rng.integers(0, 5000, 12)]) for _ in range(40_000))


def test_sizes(long_text):
    assert len(long_text.encode()) > 2 << 20


def test_licenses(spark, long_text):
    found = by_id(license_scan.license_matches(docs(spark, ["", long_text + " Released under the MIT License"])))
    assert found[1]["n_words"] == len(license_scan.words_of(long_text.encode())) + 5 and [p["label"] for p in found[1]["places"]] == ["mit"]


def test_repeats(spark, long_text):
    size = len(long_text.encode())
    found = by_id(suffix_dedup.repeat_report(docs(spark, [long_text, long_text[: size // 4], long_text[::-1][:300]])))
    covered = len(long_text[: size // 4].encode())
    assert (found[0]["n_bytes"], found[0]["n_removed"], found[0]["n_spans"], found[1]["n_removed"], found[2]["n_removed"]) == (size, covered, 1, covered, 0)
    assert found[0]["kept_sha256"] == hashlib.sha256(long_text.encode()[covered:]).hexdigest()
    assert suffix_dedup.repeat_report(docs(spark, [])).count() == 0


def test_tokens(spark, long_text):
    import sentencepiece
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert by_id(token_counts.token_counts(docs(spark, [long_text]), path))[0]["n_tokens"] == len(model.encode(long_text))
    path = queries.tokenizer_file("word_bpe_49k.json")
    assert by_id(bpe.encode_decode(docs(spark, [long_text]), path))[0]["n_tokens"] == len(Tokenizer.from_file(path).encode(long_text, add_special_tokens=False).ids)
    assert bpe.encode_decode(docs(spark, []), path).count() == 0


def test_fingerprints_and_rules(spark, long_text):
    frame = docs(spark, [long_text, long_text, long_text + " end"])
    found = by_id(simhash.simhash_components(frame))
    assert {r["component_id"] for r in found.values()} == {0}
    assert simhash.keep_one(frame).count() == 1
    judged = {r["doc"]["doc_id"]: r for r in quality.judge(frame, carry=["doc_id"]).collect()}
    assert judged[0]["n_words"] == 480_000 and judged[0]["kept"]


def test_benchmark(spark, long_text):
    item = "which quiet harbour town keeps the oldest wooden lighthouse? the one on the western island of stones"
    items = spark.createDataFrame([(0, item)], "item_id long, text string")
    found = decontaminate.leaks(docs(spark, [long_text, long_text + "\n" + item]), items).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(1, 0)]
    assert decontaminate.leaks(docs(spark, []), items).count() == 0
