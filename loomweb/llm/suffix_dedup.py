"""Exact substring dedup: collection Burrows-Wheeler transforms built column by column.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else, in the same
document or another.  Every string of that length has an anchor: the least hash of its
``ANCHOR``-byte pieces, leftmost first.  Equal strings have equal anchors, at the same place inside, so
only documents' runs of strings around equal anchors can match.  A run is one segment of text.

1. Anchors of all documents: (anchor, segment digest, document, run).  Anchors that occur once are dropped.
2. Equal segments (128 hash bits besides the anchor's 64) become one kind with a count.
3. Each kind's bytes are cut from its document; of kinds that occur more than once, from two places, which the transform
   compares byte by byte like any others.  All kinds of an anchor are one collection, and the transform decides which of their strings repeat.
   Segments without a partner that has the same bytes over half of what is left of a string, on either side of the anchor,
   share no string with any and are left out beforehand.
4. Collections are dealt to tasks.  As equal strings hold their anchor at the same place, the collection's
   documents are aligned at the anchor and the transform falls apart into one part per column: in every round
   each document inserts its next symbol from the right, which gives the next column's order of suffixes from the
   last one's, and the common prefixes of neighbours are updated with it.  Neighbours with ``length``
   or more common bytes are repeated strings.  A round reads the last column from end to end and writes the next one,
   so a task holds its collection and two columns, whatever the corpus has.
5. A collection of more than ``MOST_BYTES`` is split first: each string has half or more of what is left of it on one
   side of its anchor, and those bytes make the anchor longer.  Equal strings stay together, equal pieces become one
   again, and after eight splits the anchor is the string itself, so no collection stays large and no string is lost.
6. Runs of repeated strings go back to all places of their kind, and the documents drop the covered bytes.

Documents are referred to by 128 hash bits of their text, as equal texts lose the same bytes; each row
counts as an occurrence of all its strings, repeated rows too.  Defined cases: null text counts as empty; texts shorter
than ``length`` keep all bytes; overlapping occurrences count; ids may be null or repeat; an empty table gives an
empty result; extra columns are ignored (or kept, by ``without_repeats``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice
from struct import Struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import release, text_key, written

LENGTH, ANCHOR = 200, 64
#: Bytes of one collection up to which a task gets it whole, and of collections that a task takes on together.
MOST_BYTES, CHUNK_BYTES = 32 << 10, 4 << 20
#: Texts are scanned in stretches of at most so many bytes.
STRETCH = 1 << 20
_TABLE = np.random.default_rng(7).integers(0, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
_TWO = Struct("=qq")
_STEPS = np.random.default_rng(8).integers(0, 1 << 63, size=16, dtype=np.uint64) | np.uint64(1)


def piece_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all pieces of ``size`` bytes, a power of two, by doubling."""
    h, n, step = _TABLE[raw], 1, 0
    while n < size:
        h = h[:-n] * _STEPS[step] + h[n:]
        n, step = 2 * n, step + 1
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def runs(raw: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(anchor hash, its place, first start, last start) of the runs of strings with one anchor."""
    found: list[tuple[np.ndarray, ...]] = []
    for low in range(0, max(0, len(raw) - length + 1), STRETCH):
        part = raw[low : low + STRETCH + length - 1]
        h = piece_hashes(part, anchor)
        bits = np.uint64(int(STRETCH + length).bit_length())  # the same for all texts, so that equal strings choose alike
        least = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)  # hash, then place
        window, n = length - anchor + 1, 1
        while 2 * n <= window:
            least = np.minimum(least[:-n], least[n:])
            n *= 2
        if window > n:
            least = np.minimum(least[: len(least) - (window - n)], least[window - n :])
        place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        cut = np.flatnonzero(np.diff(place)) + 1
        first, last = np.r_[0, cut], np.r_[cut - 1, len(place) - 1]
        found.append((h[place[first]], place[first] + low, first + low, last + low))
    if not found:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found))


def repeated_starts(keys: np.ndarray, sizes: np.ndarray, text: np.ndarray, ats: np.ndarray, core: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first, last) of runs of places whose string of ``length`` bytes stands in another segment with its key.

    text has the segments, one after the other; keys are sorted.  ats are the places of the anchors, of ``core`` or more bytes, at which
    segments are aligned.  Column by column, from the right, each segment inserts one symbol.  The suffixes that begin at the column before
    stand in order within their key; putting a symbol before each keeps the order among equal symbols, so the next order is that of
    the symbols, stably sorted.  The common prefix of neighbours is one more than the least one between the two suffixes that they extend.  A
    segment that has no symbol in a column stands first there, with nothing in common with any other."""
    n, left = len(keys), length - core
    width = left + length
    shift = left - ats  # the column of a segment's first symbol
    columns = np.zeros((width, n), np.uint8)
    columns[np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes - shift, sizes), np.repeat(np.arange(n), sizes)] = text + np.uint8(1)  # 0xFF is in no UTF-8 text
    kept = _partnered(keys, columns, core, length)
    columns, shift, n = columns[:, kept], shift[kept], len(kept)
    group = np.cumsum(np.r_[0, np.diff(keys[kept]) != 0])[:n] << 8
    order, common = np.arange(n), np.zeros(n + 1, np.int16)  # of each entry with the one before it; the last is a bound
    marks = np.zeros((left + 1, n), bool)
    for column in range(width - 1, -1, -1):
        symbols = columns[column][order]  # what stands before the suffixes, in their order: the transform
        value = group + symbols
        by = np.argsort(value, kind="stable")
        value = value[by]
        at = np.flatnonzero((value[1:] == value[:-1]) & (value[1:] & 255 > 0)) + 1
        new = np.zeros(n + 1, np.int16)
        if len(at):
            edges = np.empty(2 * len(at), np.int64)
            edges[0::2], edges[1::2] = by[at - 1] + 1, by[at] + 1
            new[at] = np.minimum.reduceat(common, edges)[0::2] + 1
        order, common = order[by], new
        if column <= left:
            hit = np.flatnonzero(common >= length)
            marks[column, order[hit]] = True
            marks[column, order[hit - 1]] = True
    edge = np.diff(np.concatenate([np.zeros((1, n), np.int8), marks.astype(np.int8), np.zeros((1, n), np.int8)]), axis=0).T
    who, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    return kept[who], first - shift[who], last - shift[who]


def _partnered(keys: np.ndarray, columns: np.ndarray, core: int, length: int) -> np.ndarray:
    """The segments that another one with their key equals over half of what a string has beside the anchor, left or right of it.

    Any two equal strings do: the longer side of both has that much, and its bytes are the same."""
    n, left = len(keys), length - core
    half = (left + 1) // 2
    found = np.zeros(n, bool)
    for low, high in ((left - half, left), (left + core, left + core + left - half + 1)):
        value = keys.astype(np.uint64)
        for column in range(low, min(high, len(columns))):
            value = (value ^ columns[column]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        order = np.argsort(value, kind="stable")
        same = np.r_[False, value[order][1:] == value[order][:-1]]
        same[:-1] |= same[1:].copy()
        found[order[same]] = True  # where bytes are missing their zeros may agree, which only keeps more than is needed
    return np.flatnonzero(found)


def _digest(piece: bytes) -> tuple[int, int]:
    import xxhash

    return _TWO.unpack(xxhash.xxh3_128_digest(piece))


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest as digest

        for batch in batches:
            g, at, row, first, last, digests = [], [], [], [], [], []
            for n, text in enumerate(batch.column(2)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if len(raw) < length:
                    continue
                h, p, a, z = runs(np.frombuffer(raw, dtype=np.uint8), length)
                g.append(h.view(np.int64))
                at.append(p - a)
                digests += [digest(raw[i:j]) for i, j in zip(a.tolist(), (z + length).tolist())]
                row.append(np.full(len(h), n))
                first.append(a)
                last.append(z)
            joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (g, at, row, first, last)]
            rows = pa.array(joined[2])
            two = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            columns = [pa.array(joined[0]), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(joined[k].astype(np.int32)) for k in (3, 4, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["g", "d1", "d2", "k1", "k2", "first", "last", "at"])

    return run


def _decide(length: int):
    """Rows (g, d1, d2, copy, at, core, piece) sorted by g: the runs of repeated strings of each kind, by the transform."""
    names = ["g", "d1", "d2", "first", "last"]

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        g, d1, d2, copy, at, core = (rows.column(k).to_numpy().astype(np.int64) for k in range(6))
        pieces = rows.column(6).chunk(0) if rows.num_rows else pa.array([], pa.binary())
        ends = np.frombuffer(pieces.buffers()[1], dtype=np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
        text = np.frombuffer(pieces.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
        who, first, last = repeated_starts(g, np.diff(ends), text, at, int(core.min()), length)
        own = copy[who] == 0
        who, first, last = who[own], first[own].astype(np.int32), last[own].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (g[who], d1[who], d2[who], first, last)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column(6).nbytes
            if size >= CHUNK_BYTES:  # all but the last key, which may go on
                keys = batch.column(0).to_numpy()
                cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
                if cut:
                    yield solve([*held[:-1], batch.slice(0, cut)])
                    held = [batch.slice(cut)]
                    size = held[0].column(6).nbytes
        if held:
            yield solve(held)

    return run


def halves(piece: bytes, at: int, core: int, length: int = LENGTH) -> Iterator[tuple[int, int, int, bytes]]:
    """(start in the piece, anchor's place, its size, bytes) of the two parts by the side on which a string has more left; one part's strings are none of the other's."""
    rest, last = length - core, len(piece) - length
    half = (rest + 1) // 2
    if at >= half:  # strings with half or more on the left
        yield 0, at - half, core + half, piece[: min(last, at - half) + length]
    start = max(0, at - half + 1)
    if start <= last:
        yield start, at - start, core + rest - half + 1, piece[start:]


def _split(length: int):
    """Rows (g, d1, d2, n, at, core, piece): their halves under their longer anchors, with where they come from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out: list[tuple] = []
            for g, d1, d2, n, at, core, piece in zip(*(c.to_pylist() for c in batch.columns)):
                for start, place, size, part in halves(piece, at, core, length):
                    key = xxhash.xxh64_intdigest(part[place : place + size], size) - (1 << 63)
                    out.append((g, d1, d2, start, n, key, *_digest(part), place, size, part))
            cols = list(zip(*out)) if out else [()] * 11
            kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["_g", "_d1", "_d2", "start", "n", "g", "d1", "d2", "at", "core", "piece"])

    return run


def repeated_spans(kinds: DataFrame, pieces: DataFrame, length: int = LENGTH, most: int = MOST_BYTES) -> DataFrame:
    """(g, d1, d2, first, last): the runs of starts that repeat of each kind.

    kinds has (g, d1, d2, n, size); pieces has (g, d1, d2, copy, n, at, core, piece), two copies of kinds with n > 1."""
    total = F.sum(F.col("size") * F.when(F.col("n") > 1, 2).otherwise(1))
    large = written(kinds.groupBy("g").agg(total.alias("total")).where(F.col("total") > most).select(F.col("g").alias("_key")), "large")
    split = not large.isEmpty()
    if split:
        pieces = written(pieces, "pieces")
    small = pieces.join(large, F.col("g") == F.col("_key"), "left_anti") if split else pieces
    small = small.select("g", "d1", "d2", "copy", "at", "core", "piece").repartition("g").sortWithinPartitions("g")
    found = small.mapInArrow(_decide(length), "g bigint, d1 bigint, d2 bigint, first int, last int")
    if not split:
        return found
    hot = pieces.where("copy = 0").join(large, F.col("g") == F.col("_key"), "left_semi").select("g", "d1", "d2", "n", "at", "core", "piece")
    parts = written(hot.mapInArrow(_split(length), "_g bigint, _d1 bigint, _d2 bigint, start int, n bigint, g bigint, d1 bigint, d2 bigint, at int, core int, piece binary"), "parts")
    below = parts.groupBy("g", "d1", "d2").agg(F.sum("n").alias("n"), F.min(F.struct("at", "core", "piece")).alias("one"))
    below = written(below.select("g", "d1", "d2", "n", "one.*", F.octet_length("one.piece").alias("size")), "kinds")
    several = below.groupBy("g").agg(F.sum("n").alias("m")).where("m > 1").select(F.col("g").alias("_key"))
    below = below.join(written(several, "several"), F.col("g") == F.col("_key"), "left_semi")
    copies = F.explode(F.when(F.col("n") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    spans = repeated_spans(below.select("g", "d1", "d2", "n", "size"), below.select("g", "d1", "d2", copies, "n", "at", "core", "piece"), length, most)
    spans = written(spans.withColumnsRenamed({c: f"_{c}" for c in ("g", "d1", "d2")}), "spans")
    up = parts.select(F.col("_g").alias("g0"), F.col("_d1").alias("d10"), F.col("_d2").alias("d20"), "start", "g", "d1", "d2")
    back = up.join(spans, [F.col(c) == F.col(f"_{c}") for c in ("g", "d1", "d2")])
    return found.unionByName(back.select(F.col("g0").alias("g"), F.col("d10").alias("d1"), F.col("d20").alias("d2"), (F.col("first") + F.col("start")).alias("first"), (F.col("last") + F.col("start")).alias("last")))


def repeated_runs(docs: DataFrame, length: int = LENGTH, most: int = MOST_BYTES) -> DataFrame:
    """(k1, k2, first, last): runs of starts whose strings repeat, by text; docs has text and its text_key()."""
    anchors = docs.select("k1", "k2", "text").mapInArrow(_anchors(length), "g bigint, d1 bigint, d2 bigint, k1 bigint, k2 bigint, first int, last int, at int")
    anchors = written(anchors, "anchors")
    twice = written(anchors.groupBy("g").count().where("count > 1").select(F.col("g").alias("_g")), "twice")
    rows = written(anchors.join(twice, F.col("g") == F.col("_g")).drop("_g"), "candidates")
    release(anchors, twice)
    place = F.struct("k1", "k2", "first", "last", "at")
    kinds = rows.groupBy("g", "d1", "d2").agg(F.count("*").alias("n"), F.min(place).alias("low"), F.max(place).alias("high"))
    kinds = written(kinds, "kinds")
    copies = F.when(F.col("n") > 1, F.array(F.struct(F.lit(0).alias("copy"), "low.*"), F.struct(F.lit(1).alias("copy"), "high.*"))).otherwise(F.array(F.struct(F.lit(0).alias("copy"), "low.*")))
    # a document's asks are one per kind that it was chosen for, in all no more than a part of its own size
    asked = kinds.select("g", "d1", "d2", "n", F.explode(copies).alias("c")).select("g", "d1", "d2", "n", "c.*")
    asks = F.struct("g", "d1", "d2", "copy", "n", "at", "first", (F.col("last") + length).alias("end"))
    asked = written(asked.groupBy("k1", "k2").agg(F.collect_list(asks).alias("asks")), "asked")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asks = batch.column(1).flatten()
            g, d1, d2, copy, n, at, first, end = (asks.field(k) for k in range(8))
            sizes = batch.column(1).value_lengths().to_pylist()
            places = zip(first.to_pylist(), end.to_pylist())
            pieces = [raw[a:z] for text, size in zip(batch.column(0), sizes) for raw in (text.as_buffer().to_pybytes(),) for a, z in islice(places, size)]
            yield pa.RecordBatch.from_arrays([g, d1, d2, copy, n, at, pa.array(np.full(len(pieces), ANCHOR, np.int32)), pa.array(pieces, pa.binary())], names=["g", "d1", "d2", "copy", "n", "at", "core", "piece"])

    # of equal texts one is cut
    texts = docs.dropDuplicates(["k1", "k2"])
    chosen = texts.join(asked, ["k1", "k2"]).select("text", "asks")
    pieces = chosen.mapInArrow(cut, "g bigint, d1 bigint, d2 bigint, copy int, n bigint, at int, core int, piece binary")
    sized = kinds.select("g", "d1", "d2", "n", (F.col("low.last") - F.col("low.first") + length).alias("size"))
    spans = written(repeated_spans(sized, pieces, length, most).withColumnsRenamed({c: f"_{c}" for c in ("g", "d1", "d2", "first", "last")}), "spans")
    found = rows.join(spans, [F.col(c) == F.col(f"_{c}") for c in ("g", "d1", "d2")])
    return found.select("k1", "k2", (F.col("first") + F.col("_first")).alias("first"), (F.col("first") + F.col("_last")).alias("last"))


def _keyed(docs: DataFrame, text_col: str, *more) -> DataFrame:
    return docs.select(*more, F.coalesce(F.col(text_col), F.lit("")).alias("text"), *text_key(text_col))


def _removals(keyed: DataFrame, length: int, most: int) -> DataFrame:
    """(k1, k2, runs): the runs of each text that has any."""
    found = repeated_runs(keyed.select("k1", "k2", "text"), length, most)
    return written(found.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("runs")), "runs")


def drop_runs(raw: bytes, found: list[dict] | None, length: int = LENGTH) -> tuple[bytes, int, int]:
    """(kept bytes, removed bytes, removed spans)."""
    kept, at, spans, end = [], 0, 0, -1
    for r in found or ():
        first, last = r["first"], r["last"] + length
        if first > end:
            kept.append(raw[at:first])
            spans += 1
        end = at = max(end, last)
    kept.append(raw[at:])
    rest = b"".join(kept)
    return rest, len(raw) - len(rest), spans


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, most: int = MOST_BYTES) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1), batch.column(2).to_pylist()):
                raw = text.as_buffer().to_pybytes()
                rest, removed, spans = drop_runs(raw, found, length)
                out.append((len(raw), removed, spans, hashlib.sha256(rest).hexdigest()))
            cols = list(zip(*out)) if out else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    keyed = _keyed(docs, text_col, F.col(id_col).alias("id"))
    joined = keyed.join(_removals(keyed, length, most), ["k1", "k2"], "left")
    schema = StructType(StructType().add("id", keyed.schema["id"].dataType).fields + StructType.fromDDL("n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string").fields)
    return joined.select("id", "text", "runs").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, most: int = MOST_BYTES) -> DataFrame:
    """docs with the repeated bytes of text_col gone; bytes of a character that was cut in two are dropped as well."""

    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                t.as_py() if not (t.is_valid and found) else drop_runs(t.as_buffer().to_pybytes(), found, length)[0].decode(errors="ignore")
                for t, found in zip(batch.column(place), batch.column(batch.num_columns - 1).to_pylist())
            ]
            columns = [*batch.columns[:-1]]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    removals = _removals(_keyed(docs, text_col), length, most)
    k1, k2 = text_key(text_col)
    extra = "_" * (1 + max(map(len, docs.columns))) + "runs"  # a name that no column has
    rows = docs.select(F.struct("*").alias("doc"), k1, k2).join(removals, ["k1", "k2"], "left")
    return rows.select("doc.*", F.col("runs").alias(extra)).mapInArrow(run, docs.schema)
