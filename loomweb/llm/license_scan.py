"""License scans: an exact set-similarity join of text blocks and license templates.

A text's words are cut into overlapping blocks, whose size goes with the template's: a template of up to ``s`` words, s a
power of two and STRIDE at least, is sought in blocks of 2 s words that begin every s words, so any run of up to s + 1 words lies
whole in one block.  A template matches a block that holds at least ``threshold`` of its distinct words.  The join is exact:

- all words are ordered by their frequency over the whole corpus, rarest first;
- prefix filter: a block that shares ``need`` words with a template shares one of its
  first ``len - need + 1`` words in that order;
- length filter: the block must hold ``need`` distinct template words at all;
- positional filter: behind the first shared word there must be enough words left in
  both ordered lists;
- what survives is verified by counting shared words.

Phrases are templates with threshold 1 whose words must also stand consecutively.
Templates are a bounded parameter, of any length, so their prefix index goes to every task.  The corpus is read twice: the
word order needs the frequencies of all of it, of which only those of template words are kept.

Defined cases: null text counts as empty; a text without words has no match and score 0;
repeated rows each get a row; null ids are ids; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The phrases of the contract.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Notices as they usually stand in files, and whole license texts.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution noncommercial license", "cc-by-nc"),
    ("licensed under a creative commons attribution sharealike license", "cc-by-sa"),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "mit",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list "
        "of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
        "CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "bsd",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS.",
        "isc",
    ),
)
THRESHOLD, STRIDE = 0.8, 32
#: Keeps word bytes (ASCII digits, a-z and all non-ASCII), lower-cases A-Z and blanks all others.
WORD_BYTES = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


@dataclass(frozen=True)
class Template:
    words: tuple[bytes, ...]
    label: str
    threshold: float
    phrase: bool  # words must stand consecutively

    @property
    def need(self) -> int:
        return ceil(self.threshold * len(set(self.words)) - 1e-9)


def templates(phrases=PHRASES, notices=NOTICES, threshold: float = THRESHOLD) -> list[Template]:
    return [Template(tuple(words_of(t.encode())), label, 1.0, True) for t, label in phrases] + [Template(tuple(words_of(t.encode())), label, threshold, False) for t, label in notices]


class PrefixIndex:
    """Templates under a global word order."""

    def __init__(self, found: list[Template], frequency: dict[bytes, int], stride: int = STRIDE):
        found = [t for t in found if t.words]
        self.templates = found
        self.strides = [max(stride, 1 << (len(t.words) - 1).bit_length()) for t in found]
        vocabulary = sorted({w for t in found for w in t.words}, key=lambda w: (frequency.get(w, 0), w))
        self.order = {w: n for n, w in enumerate(vocabulary)}  # rarest first
        self.sorted = [sorted(self.order[w] for w in set(t.words)) for t in found]
        self.by_prefix: dict[int, list[int]] = defaultdict(list)
        for n, (t, ranks) in enumerate(zip(found, self.sorted)):
            for rank in ranks[: len(ranks) - t.need + 1]:
                self.by_prefix[rank].append(n)
        self.prefix_words = frozenset(w for w, rank in self.order.items() if rank in self.by_prefix)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, float]]]:
        """Places (label, first word, words) of phrases; blocks (label, first word, containment) of notices."""
        if self.prefix_words.isdisjoint(words):
            return [], []
        order, index = self.order, self.by_prefix
        # block b of a template's stride s has the words from s b to s (b + 2)
        candidates = {(n, b) for place, w in enumerate(words) if w in self.prefix_words for n in index[order[w]] for b in (place // self.strides[n] - 1, place // self.strides[n]) if b >= 0}
        places: set[tuple[str, int, int]] = set()
        blocks: list[tuple[str, int, float]] = []
        ranks_of: dict[tuple[int, int], list[int]] = {}
        for n, b in sorted(candidates, key=lambda x: (x[1] * self.strides[x[0]], x[0])):
            start, end = b * self.strides[n], (b + 2) * self.strides[n]
            block = words[start:end]
            ranks = ranks_of.get((start, end))
            if ranks is None:
                ranks = ranks_of[start, end] = sorted({order[w] for w in block if w in order})
            t, own = self.templates[n], self.sorted[n]
            if len(ranks) < t.need:  # length
                continue
            at = {rank: j for j, rank in enumerate(ranks)}
            first = next(((i, at[rank]) for i, rank in enumerate(own) if rank in at), None)
            if first is None or min(len(own) - first[0], len(ranks) - first[1]) < t.need:  # position
                continue
            shared = sum(rank in at for rank in own)
            if shared < t.need:
                continue
            if not t.phrase:
                blocks.append((t.label, start, shared / len(own)))
                continue
            size, head = len(t.words), t.words[0]
            for i, w in enumerate(block):
                if w == head and tuple(block[i : i + size]) == t.words:
                    places.add((t.label, start + i, size))
        return sorted(places, key=lambda p: (p[1], p[0])), blocks


def license_matches(docs: DataFrame, found: list[Template] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, places, blocks) per row."""
    found = templates() if found is None else found
    vocabulary = frozenset(w for t in found for w in t.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    seen.update(filter(vocabulary.__contains__, words_of(text.as_buffer().to_pybytes())))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    sums = docs.select(text_col).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    frequency = {bytes(r["word"]): r["n"] for r in sums.collect()}  # as many rows as templates have words
    index = docs.sparkSession.sparkContext.broadcast(PrefixIndex(found, frequency))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))
        block = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("containment", pa.float64())]))
        for batch in batches:
            n, places, blocks = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_buffer().to_pybytes()) if text.is_valid else []
                p, b = index.value.scan(words)
                n.append(len(words))
                places.append([dict(zip(("label", "first", "words"), x)) for x in p])
                blocks.append([dict(zip(("label", "first", "containment"), x)) for x in b])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(places, place), pa.array(blocks, block)], names=["id", "n_words", "places", "blocks"])

    schema = StructType().add("id", docs.schema[id_col].dataType)
    schema = StructType(schema.fields + StructType.fromDDL("n_words bigint, places array<struct<label string, first bigint, words bigint>>, blocks array<struct<label string, first bigint, containment double>>").fields)
    return docs.select(id_col, text_col).mapInArrow(scan, schema).withColumnRenamed("id", id_col)
