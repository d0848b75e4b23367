"""Benchmark decontamination: a BM25 index of test items, searched with block-max WAND.

Test items are cut into pieces of at most ``PIECE`` words, the indexed documents, and every training passage is a
query.  Passages have ``PASSAGE`` words and overlap by half, so a piece that a text quotes lies whole in one of them,
however long its item is.  Posting weights are BM25 contributions divided by the piece's own score, so one threshold
holds for all pieces.  Postings are cut into blocks of piece numbers that are the same for all terms; each term has a
list of the blocks it is in with its largest weight there.  All passages of a text are bounded at once, by the entries of
lists of up to ``SHORT`` blocks and the maxima of longer ones; those of which no block can reach the threshold are left.  For each other passage
the terms with the smallest list maxima that together cannot reach the threshold choose no block.  The other terms' blocks are
candidates; the rest of the lists are entered by cursors that skip to these, the heaviest lists first (short lists are
read whole instead), and a block is left as soon as what is known of it and the maxima of the lists still to come stay below the threshold.
Only blocks that remain are scored.  Every piece at or
above the threshold is retrieved and its item verified: half of the words of both the item's question (up to its
first sentence or line end) and its answer (the rest) must be there, and ``PAIR_OVERLAP`` of its word pairs, which
tells edited items from other texts of the same words.  The share of its five-word shingles
is reported, not a condition.

The index is broadcast in parts of at most ``PART_BYTES`` of item text; with more items
the training texts are read once per part.  The numbers of pieces, words and pieces with a
word are those of all parts, and pieces and passages have fixed sizes, so neither the parts nor other items' length change a
score more than those numbers do.

Defined cases: null texts count as empty; an item without words matches nothing; an item of
under five words is one shingle; an item of one word needs that word, and counts as found where it stands; repeated rows each
count; null ids are ids; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .license_scan import words_of
from .shared import text_key, written

K1, B = 1.2, 0.75
THRESHOLD, PAIR_OVERLAP, PART_OVERLAP, SHINGLE = 0.5, 0.4, 0.5, 5
PASSAGE, PIECE, BLOCK = 128, 64, 4
PART_BYTES = 32 << 20
#: Bounds and scores add up in different orders; what a bound discards is below the threshold by more than that.
SLACK = 1e-9
LEAST, FEW, SHORT, CELLS = THRESHOLD - SLACK, 16, 64, 1 << 18
_QUESTION = re.compile(rb"^.*?(?:[.?!](?=\s)|\n|$)", re.S)


def shingles(words: list[bytes], size: int = SHINGLE) -> set[bytes]:
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def pieces_of(words: list[bytes]) -> list[list[bytes]]:
    """The words in pieces of nearly equal length, PIECE at most."""
    n = -(-len(words) // PIECE)
    return [words[len(words) * k // n : len(words) * (k + 1) // n] for k in range(n)]


def _ranges(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = (end - first).cumsum()
    return np.repeat(end - ends, end - first) + np.arange(ends[-1] if len(ends) else 0)


class Index:
    """BM25 postings of the items' pieces, with the largest weight of each term in each block it is in."""

    def __init__(self, items: list[tuple[int, str]], totals: tuple[int, int] | None = None, df: dict[bytes, int] | None = None):
        """totals (pieces and their words) and df are those of all items, where these are a part of them."""
        raw = [(i, (t or "").encode()) for i, t in items]
        self.items = [(i, w) for i, t in raw if (w := words_of(t))]
        texts = [t for _, t in raw if words_of(t)]
        pieces = [(n, p) for n, (_, words) in enumerate(self.items) for p in pieces_of(words)]
        self.item_of = [n for n, _ in pieces]
        n, n_words = totals or (len(pieces), sum(len(p) for _, p in pieces))
        df = df or Counter(w for _, words in pieces for w in set(words))
        mean = n_words / max(1, n)
        postings: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        for number, (_, words) in enumerate(pieces):
            tf = Counter(words)
            part = {w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(words) / mean)) for w, f in tf.items()}
            own = sum(part.values())
            for w, x in part.items():
                postings[w].append((number, x / own))
        self.term = {w: t for t, w in enumerate(postings)}
        #: Postings by term: (piece, weight); term t's are those from start[t] on.
        sizes = [len(p) for p in postings.values()]
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.numbers = np.array([i for p in postings.values() for i, _ in p], dtype=np.int64)
        self.weights = np.array([x for p in postings.values() for _, x in p])
        terms = np.repeat(np.arange(len(sizes)), sizes)
        #: Sorted keys of (term, piece), by which a cursor finds its place.
        self.key = terms * (len(pieces) + BLOCK) + self.numbers
        #: Block lists by term, in the same way: (block, the term's largest weight there).
        self.n_blocks = -(-len(pieces) // BLOCK)
        new = np.flatnonzero(np.r_[True, (np.diff(terms) != 0) | (np.diff(self.numbers // BLOCK) != 0)][: len(terms)])
        self.block_start = np.searchsorted(terms[new], np.arange(len(sizes) + 1))
        self.blocks = (self.numbers // BLOCK)[new]
        self.block_key = terms[new] * self.n_blocks + self.blocks
        self.block_most = np.maximum.reduceat(self.weights, new) if len(new) else np.zeros(0)
        self.most = np.maximum.reduceat(self.weights, self.start[:-1]) if len(sizes) else np.zeros(0)
        self.shingles = [shingles(w) for _, w in self.items]
        self.pairs = [shingles(w, 2) for _, w in self.items]
        self.parts = []
        for (_, words), text in zip(self.items, texts):
            question = words_of(_QUESTION.match(text)[0])
            if not question or len(question) == len(words):
                question = words[: -(-len(words) // 2)]
            self.parts.append((set(question), set(words[len(question) :]) or set(question)))

    def search(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """(piece, score) of those whose score for the distinct terms reaches the threshold."""
        most = self.most[terms]
        order = most.argsort()
        below = most[order].cumsum()
        pivot = int(below.searchsorted(LEAST))  # the terms before it cannot reach the threshold together
        if pivot == len(terms):
            return []
        start, end = self.block_start[terms], self.block_start[terms + 1]
        late = order[:pivot]
        late = late[end[late] - start[late] > SHORT]  # a short list is read faster than a cursor finds its place
        whole = np.ones(len(terms), bool)
        whole[late] = False
        at = _ranges(start[whole], end[whole])
        bound = np.bincount(self.blocks[at], self.block_most[at], self.n_blocks)
        rest = most[late].cumsum()
        left = len(late)
        blocks = (bound >= LEAST - (rest[-1] if left else 0.0)).nonzero()[0]
        bound = bound[blocks]
        while left and len(blocks):  # the heaviest lists that are left
            low = max(0, left - FEW)
            keys = terms[late[low:left], None] * self.n_blocks + blocks
            cursor = np.minimum(self.block_key.searchsorted(keys), len(self.block_key) - 1)
            bound = bound + np.where(self.block_key[cursor] == keys, self.block_most[cursor], 0.0).sum(axis=0)
            left = low
            alive = bound >= LEAST - (rest[left - 1] if left else 0.0)
            blocks, bound = blocks[alive], bound[alive]
        if not len(blocks):
            return []
        first = np.sort(terms)[:, None] * (len(self.item_of) + BLOCK) + blocks * BLOCK
        at = _ranges(self.key.searchsorted(first.ravel()), self.key.searchsorted((first + BLOCK).ravel()))
        numbers = self.numbers[at]
        scores = np.bincount(blocks.searchsorted(numbers // BLOCK) * BLOCK + numbers % BLOCK, self.weights[at], len(blocks) * BLOCK)
        hit = np.flatnonzero(scores >= THRESHOLD)
        return list(zip((blocks[hit // BLOCK] * BLOCK + hit % BLOCK).tolist(), scores[hit].tolist()))

    def reaching(self, passage: np.ndarray, term: np.ndarray, n: int) -> list[int]:
        """Passages of which a block can reach the threshold, by short lists' entries and long lists' maxima.

        passage and term are pairs in order of passages, of numbers below n."""
        high = np.bincount(passage, self.most[term], n) >= LEAST
        keep = high[passage]
        passage, term = passage[keep], term[keep]
        first, end = self.block_start[term], self.block_start[term + 1]
        long = end - first > SHORT
        rest = np.bincount(passage[long], self.most[term[long]], n)
        passage, first, end = passage[~long], first[~long], end[~long]
        out: list[int] = []
        step = max(1, CELLS // max(1, self.n_blocks))
        alive = np.flatnonzero(high)
        for some in np.split(alive, range(step, len(alive), step)):
            a, z = passage.searchsorted((some[0], some[-1] + 1)) if len(some) else (0, 0)
            at = _ranges(first[a:z], end[a:z])
            cell = np.repeat(some.searchsorted(passage[a:z]), end[a:z] - first[a:z]) * self.n_blocks + self.blocks[at]
            bound = np.bincount(cell, self.block_most[at], len(some) * self.n_blocks).reshape(len(some), self.n_blocks).max(axis=1)
            out += some[bound + rest[some] >= LEAST].tolist()
        return out

    def matches(self, text: bytes) -> list[tuple[int, float, float, int]]:
        """(item id, score, shingle overlap, first word of the passage) of the best passage of each verified item."""
        words = words_of(text)
        known = self.term.get
        ids = np.array([known(w, -1) for w in words], dtype=np.int64)
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return []
        terms = ids[at]
        order = np.lexsort((at, terms))
        before = np.full(len(at), -1)
        same = terms[order][1:] == terms[order][:-1]
        before[order[1:][same]] = at[order[:-1][same]]
        # pairs of a passage and a term at its first place there, both shifts one after the other
        passages, own, base = [], [], 0
        for shift in (0, PASSAGE // 2):  # passages that overlap by half
            number = (at + shift) // PASSAGE
            new = before < number * PASSAGE - shift
            passages.append(number[new] + base)
            own.append(terms[new])
            base += len(words) // PASSAGE + 2
        passage, term = np.concatenate(passages), np.concatenate(own)
        found: dict[int, tuple[float, float, int]] = {}
        for p in self.reaching(passage, term, 2 * base):
            low, high = passage.searchsorted((p, p + 1))
            number, shift = (p, 0) if p < base // 2 else (p - base // 2, PASSAGE // 2)
            start = number * PASSAGE - shift
            best: dict[int, float] = {}
            for piece, score in self.search(term[low:high]):
                item = self.item_of[piece]
                best[item] = max(best.get(item, 0.0), score)
            for item, score in best.items():
                margin = len(self.items[item][1])
                overlap = self.verify(item, words[max(0, max(0, start) - margin) : start + PASSAGE + margin])
                if overlap is not None:  # the best passage, the first of equal ones
                    found[item] = max(found.get(item, (0.0, 0.0, 0)), (overlap, round(score, 9), -max(0, start)))
        return [(self.items[i][0], score, overlap, -start) for i, (overlap, score, start) in sorted(found.items())]

    def verify(self, item: int, words: list[bytes]) -> float | None:
        """The share of the item's shingles among the words, where its pairs, the question and the answer overlap enough."""
        own, pairs, n_words = self.shingles[item], self.pairs[item], len(self.items[item][1])
        there = set(words)
        if any(len(p & there) < PART_OVERLAP * len(p) for p in self.parts[item]):
            return None
        if len(pairs & shingles(words, min(2, n_words))) < PAIR_OVERLAP * len(pairs):
            return None
        return len(own & shingles(words, min(SHINGLE, n_words))) / len(own)


def item_words(items: DataFrame, item_text: str) -> DataFrame:
    """(_part, n_words, words): of each piece of the items its number of words and the different ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(n, p) for n, t in enumerate(batch.column(1).to_pylist()) for p in pieces_of(words_of((t or "").encode()))]
            rows = pa.array([n for n, _ in found], pa.int64())
            columns = [batch.column(0).take(rows), pa.array([len(p) for _, p in found], pa.int64()), pa.array([sorted(set(p)) for _, p in found], pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["_part", "n_words", "words"])

    return items.select("_part", item_text).mapInArrow(run, "_part bigint, n_words bigint, words array<binary>")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id_col, item_id, score, overlap, first_word): a row for each row of docs and test item found in it."""
    spark = docs.sparkSession
    size = items.agg(F.sum(F.octet_length(item_text) + 16)).first()[0] or 0
    n_parts = 1 + 2 * int(size) // PART_BYTES
    schema = StructType().add("id", docs.schema[id_col].dataType)
    schema = StructType(schema.fields + StructType.fromDDL("item bigint, score double, overlap double, first_word bigint").fields)
    items = items.select(item_id, item_text, F.pmod(F.xxhash64(item_id, item_text), F.lit(n_parts)).cast("bigint").alias("_part"))
    totals, df, found = None, None, None
    if n_parts > 1:  # every part scores by the figures of all items
        own = written(item_words(items, item_text), "item_words")
        totals = tuple(own.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first())
        words = own.select("_part", F.explode("words").alias("word"))
        df = words.groupBy("word").agg(F.count("*").alias("df"))
        df = written(words.groupBy("_part", "word").agg(F.lit(1)).join(df, "word").select("_part", "word", "df"), "item_df")
    for part in range(n_parts):
        rows = items.where(F.col("_part") == part).select(F.col(item_id).cast("bigint"), item_text).collect()
        known = {bytes(r["word"]): r["df"] for r in df.where(F.col("_part") == part).collect()} if df is not None else None
        index = spark.sparkContext.broadcast(Index(sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0)), totals, known))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, out = [], []
                for n, text in enumerate(batch.column(1)):
                    hits = index.value.matches(text.as_buffer().to_pybytes()) if text.is_valid else []
                    at += [n] * len(hits)
                    out += hits
                cols = list(zip(*out)) if out else [()] * 4
                kinds = (pa.int64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["id", "item", "score", "overlap", "first_word"])

        one = docs.select(id_col, text_col).mapInArrow(run, schema)
        found = one if found is None else found.unionByName(one)
    return found.withColumnRenamed("id", id_col).withColumnRenamed("item", item_id)


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs in which no test item was found; rows are told apart by id and text, null ids too."""
    key = [F.col(id_col).alias("_row_id"), *text_key(text_col)]
    rows = docs.select(F.struct("*").alias("doc"), *key)
    hit = leaks(docs.select(F.struct(*key).alias("_key"), F.col(text_col).alias("text")), items, "_key").select("_key.*").distinct()
    same = [rows[k].eqNullSafe(hit[k]) for k in ("_row_id", "k1", "k2")]
    return rows.join(hit, same, "left_anti").select("doc.*")
