"""Token counts without token ids.

No piece of the vocabulary holds white space after other text, so no merge crosses
the place where a run of spaces begins and a text's count is the sum over its
pre-tokens.  Pieces are counted once per distinct pre-token: for frequent ones in a
table of bounded size that every task gets, for all others where their occurrences
meet.  The rows that travel are (row, pre-token, frequency) of the others only.

Frequent pre-tokens are found over all texts: each task keeps its most frequent ones,
these are summed, and the most frequent sums stay.  Which ones they are changes the
speed alone, never a count, and a hot pre-token is always among them.

Defined cases: null text counts as empty and has 0 tokens and 0 bytes; repeated rows
each get a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import release, written

#: Bounds of the frequent table: entries, their bytes in all, and entries that one task proposes.
FREQUENT, FREQUENT_BYTES, PROPOSED = 200_000, 4 << 20, 100_000
#: Pre-tokens a task counts before it drops the rare ones of its proposal.
PROPOSAL_LIMIT = 1_000_000


class Pieces:
    """Counts of single pre-tokens under one SentencePiece model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("pieces that cross white space")

    def counts(self, tokens: list[str]) -> list[int]:
        """Token counts of pre-tokens: one starting with a space stands as it does inside a text; others follow a line break.

        The model puts one space before any text; a line break is a token of its own that joins with nothing."""
        inside = [t[:1] == " " and t != " " for t in tokens]  # the model puts no space before an empty text
        found = self.model.encode([t[1:] if i else "\n" + t for t, i in zip(tokens, inside)], num_threads=1)
        return [len(f) - (0 if i else 2) for f, i in zip(found, inside)]


_PRE_TOKENS = re.compile(r" *[^ \n]+|\n| +").findall


def pre_tokens(text: str) -> list[str]:
    """Pieces of a text whose token counts add up: a word with the spaces before it; line breaks stand alone.

    The first one has the space that the model puts before a text; the model's own sign for a space counts as one."""
    return _PRE_TOKENS(" " + text.replace("▁", " ")) if text else []


def _proposals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0):
            seen.update(pre_tokens(text.as_py() or ""))
            if len(seen) > PROPOSAL_LIMIT:
                seen = Counter(dict(seen.most_common(PROPOSAL_LIMIT // 2)))
    top = seen.most_common(PROPOSED)
    yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["token", "n"])


def frequent_table(docs: DataFrame, path: str, text_col: str = "text") -> dict[str, int]:
    """Token counts of at most FREQUENT pre-tokens with FREQUENT_BYTES in all: those of the highest classes of frequency.

    The classes, 8 to a doubling, are summed up first, so the driver gets a histogram of a few hundred rows and then the chosen
    pre-tokens alone, from all tasks together no more than the bounds."""
    top = docs.select(text_col).mapInArrow(_proposals, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    top = written(top.withColumn("class", F.floor(8 * F.log2("n")).cast("int")), "proposals")
    rows = top.groupBy("class").agg(F.count("*").alias("n"), F.sum(F.octet_length("token")).alias("size")).orderBy(F.desc("class")).collect()
    n, size, least = 0, 0, None
    for r in rows:
        n, size = n + r["n"], size + r["size"]
        if n > FREQUENT or size > FREQUENT_BYTES:
            break
        least = r["class"]
    kept = [] if least is None else [r["token"] for r in top.where(F.col("class") >= least).select("token").collect()]
    release(top)
    return dict(zip(kept, Pieces(path).counts(kept)))


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) per row."""
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_table(docs, path, text_col))

    kind = docs.schema[id_col].dataType
    # a row's number is its place in its partition, which a task that runs again finds again
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value.get
        for batch in batches:
            rows, tokens, counts, sizes, ids = [], [], [], [], []
            for row, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = text.as_py() or ""
                words = pre_tokens(text)
                found = list(map(known, words))
                rare = Counter([w for w, n in zip(words, found) if n is None]) if None in found else {}
                rows += [row] * (len(rare) + 1)
                tokens += [None, *rare]
                counts += [sum(filter(None, found)), *rare.values()]
                sizes += [len(text.encode()), *[None] * len(rare)]
                ids += [own, *[None] * len(rare)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(tokens, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, batch.column(2).type)], names=["row", "token", "n", "size", "id"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, last = Pieces(path), ("", 0)
        for batch in batches:  # sorted by token
            coded = batch.column(1).dictionary_encode()
            words, codes = coded.dictionary.to_pylist(), coded.indices.to_pylist()
            new = [w for w in words if w != last[0]]
            each = dict(zip(new, pieces.counts(new))) | {last[0]: last[1]}
            n = [k if c is None else k * each[words[c]] for k, c in zip(batch.column(2).to_pylist(), codes)]
            if codes and codes[-1] is not None:
                last = (words[codes[-1]], each[words[codes[-1]]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(3), batch.column(4)], names=["row", "n", "size", "id"])

    parts = numbered.mapInArrow(split, StructType.fromDDL("row bigint, token string, n bigint, size bigint").add("id", kind))
    met = parts.repartition(F.coalesce("token", F.col("row").cast("string"))).sortWithinPartitions("token")
    sums = met.mapInArrow(count, StructType.fromDDL("row bigint, n bigint, size bigint").add("id", kind))
    per_row = sums.groupBy("row").agg(F.max("id").alias(id_col), F.sum("size").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return per_row.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
