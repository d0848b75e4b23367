"""SimHash near-duplicates with pivot distance tables.

Fingerprints that are equal collapse before any pair is looked at, so copies
never meet as pairs.  Pairs at ``max_distance`` bits or fewer must agree on some
``keep`` of ``blocks`` bit blocks (keep = blocks - max_distance), which is the
join key.  Inside a key each fingerprint has a row of Hamming distances to
reference fingerprints (pivots); by the triangle inequality a pair whose rows
differ by more than ``max_distance`` anywhere cannot be a link and is discarded.
Survivors are verified on the fingerprints themselves.  A key with many members
is split again by blocks of the bits that are still free, which loses no pair.
Tasks emit a spanning forest of the links, never all pairs.

Defined cases: null text counts as empty; a text without words has fingerprint
zero and links like any other; equal texts share a fingerprint; repeated rows are
kept; rows without an id are rows, and a component's smallest id is null only where none of its rows has one; an
empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import component_labels
from .shared import text_key, written

SEED = 42
#: Rows of hash bits that are counted at once.
VOTE_ROWS = 1 << 15
#: Groups up to this size are compared in one piece; larger ones are split by free bits.
DIRECT = 1024
N_PIVOTS = 16
#: Least-hash values per text, and how many make a band.  At a similarity of 0.8, all 32 bands differ once in 20 million pairs.
SIGNATURE, BAND = 128, 4
#: Agreeing values from which two texts are candidates: at a similarity of 0.8, fewer than 72 agree less than once in a billion pairs.
CANDIDATE = 72
#: Candidate groups up to this size are verified in one piece, and signatures of one band key compared in one piece.
MEMBERS, MET = 512, 4096
_FACTORS = np.random.default_rng(11).integers(0, 1 << 63, size=SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = np.random.default_rng(12).integers(0, 1 << 63, size=SIGNATURE, dtype=np.uint64)


def shingle_hashes(words: list[bytes], shingle_words: int) -> bytes:
    """The big-endian 64-bit hashes of the word shingles, one after the other; of all words where there are fewer."""
    import xxhash

    if not words:
        return b""
    text = b" ".join(words)
    n = max(1, len(words) - shingle_words + 1)
    spaces = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces.tolist(), len(text)]
    digest = xxhash.xxh64_digest
    return b"".join([digest(text[s:e], SEED) for s, e in zip(starts[:n], ends[min(shingle_words, len(words)) - 1 :])])


def fingerprint(hashes: bytes) -> int:
    """The 64-bit SimHash of shingles, repeats included."""
    n = len(hashes) // 8
    if not n:
        return 0
    bits = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(bits), VOTE_ROWS):
        votes += np.unpackbits(bits[at : at + VOTE_ROWS], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def signature(hashes: bytes) -> bytes:
    """16 bits of the least value of each of SIGNATURE hash functions over the shingles: equal ones estimate the sets' similarity."""
    least = np.full(SIGNATURE, np.iinfo(np.uint64).max)
    values = np.frombuffer(hashes, dtype=">u8").astype(np.uint64)
    for at in range(0, len(values), 4096):
        part = values[at : at + 4096] * _FACTORS[:, None] + _TERMS[:, None]
        least = np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=1))
    return (least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16).tobytes()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, signed: bool = False) -> DataFrame:
    """(id_col, fp): fp is the fingerprint as a signed 64-bit number; where signed, also sig, the text's signature(), and its text_key()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sigs = [], []
            for t in batch.column(1):
                hashes = shingle_hashes((t.as_buffer().to_pybytes() if t.is_valid else b"").lower().split(), shingle_words)
                fps.append(_signed(fingerprint(hashes)))
                sigs.append(signature(hashes) if signed else b"")
            columns = [batch.column(0), pa.array(fps, pa.int64())] + [pa.array(sigs, pa.binary()), *batch.columns[2:]] * signed
            yield pa.RecordBatch.from_arrays(columns, names=["id", "fp", "sig", "k1", "k2"][: len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col), *text_key(text_col) * signed)
    return rows.mapInArrow(run, f"id {kind}, fp bigint" + ", sig binary, k1 bigint, k2 bigint" * signed).withColumnRenamed("id", id_col)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random 64-bit patterns."""
    return np.random.default_rng(20240229).integers(0, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def block_masks(blocks: int, free: int = (1 << 64) - 1) -> list[int]:
    """The bits of ``free`` dealt to ``blocks`` masks of nearly equal size."""
    places = [b for b in range(64) if free >> b & 1]
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(places, dtype=np.int64), blocks)]


def key_masks(max_distance: int, n: int) -> list[int]:
    """Masks of which any pair within max_distance agrees on at least one; wider ones for more rows, so that keys stay selective."""
    keep = 1
    while keep < 5 and 64 * keep // (max_distance + keep) < max(16, int(n).bit_length() + 2):
        keep += 1
    blocks = block_masks(max_distance + keep)
    return [sum(c) for c in combinations(blocks, keep)]


def linked(fps: np.ndarray, max_distance: int, refs: np.ndarray, fixed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) that connect the members of one key as all links at max_distance do.

    ``fixed`` holds the bits on which all members agree.  fps are distinct."""
    n = len(fps)
    free = ((1 << 64) - 1) & ~fixed
    if n > DIRECT and bin(free).count("1") > max_distance + 1:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for mask in block_masks(max_distance + 1, free):
            key = fps & np.uint64(mask)
            order = np.argsort(key, kind="stable")
            edges = np.flatnonzero(np.diff(key[order])) + 1
            for members in np.split(order, edges):
                if len(members) > 1:
                    i, j = linked(fps[members], max_distance, refs, fixed | mask)
                    out.append((members[i], members[j]))
        i, j = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
        return forest(n, i, j)
    table = np.stack([popcount(fps ^ p) for p in refs], axis=1).astype(np.int8)  # the pivot distance table
    order = np.argsort(table[:, 0], kind="stable")
    table, fps = table[order], fps[order]
    left, right = [], []
    for s in range(1, n):
        a, b = table[:-s], table[s:]
        near = np.flatnonzero(b[:, 0] - a[:, 0] <= max_distance)  # sorted by the first pivot
        if not len(near):
            break  # no larger step can be nearer
        near = near[(np.abs(b[near] - a[near]) <= max_distance).all(axis=1)]
        near = near[popcount(fps[near] ^ fps[near + s]) <= max_distance]
        left.append(near)
        right.append(near + s)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(n, order[np.concatenate(left)], order[np.concatenate(right)])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each member to the smallest index of its component."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    members = np.flatnonzero(label != np.arange(n))
    return members, label[members]


def _link_batches(max_distance: int, masks: list[int]):
    refs = pivots()

    def groups(keys, which, fps):
        i_all, j_all = [], []
        cut = np.flatnonzero((np.diff(keys) != 0) | (np.diff(which) != 0)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])
        size = ends - starts
        two = starts[size == 2]
        if len(two):  # most keys: one pair
            a, b = fps[two], fps[two + 1]
            ok = np.ones(len(two), bool)
            for p in refs:
                ok &= np.abs(popcount(a ^ p).astype(np.int8) - popcount(b ^ p).astype(np.int8)) <= max_distance
            ok[ok] = popcount(a[ok] ^ b[ok]) <= max_distance
            i_all.append(two[ok] + 1)
            j_all.append(two[ok])
        for s, e in zip(starts[size > 2], ends[size > 2]):
            i, j = linked(fps[s:e], max_distance, refs, masks[int(which[s])])
            i_all.append(i + s)
            j_all.append(j + s)
        i, j = np.concatenate(i_all or [np.zeros(0, np.int64)]), np.concatenate(j_all or [np.zeros(0, np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(fps[i].view(np.int64)), pa.array(fps[j].view(np.int64))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            cols = [batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)]
            if not len(cols[0]):
                continue
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield groups(*(np.concatenate([*(h[k] for h in held), cols[k][:cut]]) for k in range(3)))
                held = []
            held.append([c[cut:] for c in cols])
        if held:
            yield groups(*(np.concatenate([h[k] for h in held]) for k in range(3)))

    return run


def links(fps: DataFrame, max_distance: int = 3) -> DataFrame:
    """(u, v): edges between distinct fingerprints (column fp) that connect what links at max_distance bits connect."""
    masks = key_masks(max_distance, fps.count())
    keyed = fps.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(t).alias("which"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])).alias("k")
    ).select("k.key", "k.which", "fp")
    dealt = keyed.repartition("key", "which").sortWithinPartitions("key", "which")
    return dealt.mapInArrow(_link_batches(max_distance, masks), "u bigint, v bigint")


def search_forest(n: int, near: Callable[[int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect 0 to n - 1 as all links do; near(x) tells for each member whether x links to it.

    A member is compared only while some are not reached, so a family of near copies takes few rows of comparisons."""
    todo = np.ones(n, bool)
    left, right = [], []
    for seed in range(n):
        queue = [seed] if todo[seed] else []
        todo[seed] = False
        while queue and todo.any():
            x = queue.pop()
            new = np.flatnonzero(near(x) & todo)
            todo[new] = False
            left.append(np.full(len(new), x))
            right.append(new)
            queue += new.tolist()
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _grouped(solve: Callable[[list[tuple]], list[tuple[int, int]]]):
    """Rows (key, id, bytes) sorted by key: the edges that solve() finds among the rows of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != held[0][0]:
                    out += solve(held) if len(held) > 1 else []
                    held = []
                held.append(row)
            yield _edges(out)
        yield _edges(solve(held) if len(held) > 1 else [])

    def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return run


def agreeing(rows: list[tuple]) -> list[tuple[int, int]]:
    """Edges between rows (key, id, signature) that connect those with CANDIDATE agreeing values."""
    table = np.frombuffer(b"".join([r[2] for r in rows]), dtype=np.uint16).reshape(len(rows), SIGNATURE)
    i, j = search_forest(len(rows), lambda x: (table == table[x]).sum(axis=1) >= CANDIDATE)
    return [(rows[a][1], rows[b][1]) for a, b in zip(i.tolist(), j.tolist())]


def _exactly(similarity: float) -> Callable[[list[tuple]], list[tuple[int, int]]]:
    """Edges between rows (key, id, shingle set) that connect those whose sets have that Jaccard similarity."""
    share = Fraction(str(similarity))

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        size = np.array([len(r[2]) // 8 for r in rows])
        start = np.concatenate([[0], np.cumsum(size)])
        names, ids = np.unique(np.frombuffer(b"".join([r[2] for r in rows]), dtype=np.uint64), return_inverse=True)
        here = np.zeros(len(names), bool)

        def near(x: int) -> np.ndarray:
            own = ids[start[x] : start[x + 1]]
            here[own] = True
            common = np.diff(np.concatenate([[0], np.cumsum(here[ids])])[start])
            here[own] = False
            return common * share.denominator >= share.numerator * (size + size[x] - common)

        i, j = search_forest(len(rows), near)
        return [(rows[a][1], rows[b][1]) for a, b in zip(i.tolist(), j.tolist())]

    return solve


def shingle_sets(texts: DataFrame, shingle_words: int) -> DataFrame:
    """texts(node, text) as (node, own): the distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for t in batch.column(1):
                hashes = shingle_hashes((t.as_buffer().to_pybytes() if t.is_valid else b"").lower().split(), shingle_words)
                sets.append(np.unique(np.frombuffer(hashes, dtype=">u8").astype(np.uint64)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "own"])

    return texts.mapInArrow(run, "node bigint, own binary")


def _part_keys(key: str) -> Column:
    """The keys under which a node of a group in ``parts`` parts is compared: with each other part, or with its only one."""
    own = F.pmod(F.xxhash64("node"), F.col("parts"))
    others = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda k: (k != own) | (F.col("parts") == 1))
    return F.transform(others, lambda k: F.xxhash64(F.col(key), F.least(k, own), F.greatest(k, own)))


def candidate_links(classes: DataFrame) -> DataFrame:
    """(u, v): edges between nodes of classes(node, sig) that connect those that meet in a band and agree in CANDIDATE values.

    Keys of one text are dropped before signatures travel; the texts of a key that more than MET share are dealt to parts, and each two parts
    are compared together."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys = [[_signed(xxhash.xxh64_intdigest(sig[2 * k : 2 * (k + BAND)], k)) for k in range(0, SIGNATURE - BAND + 1, BAND)] for sig in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["node", "keys"])

    keyed = written(classes.select("node", "sig").mapInArrow(bands, "node bigint, keys array<bigint>").select("node", F.explode("keys").alias("key")), "bands")
    parts = F.ceil(F.col("count") / MET).cast("bigint").alias("parts")
    shared = written(keyed.groupBy("key").count().where("count > 1").select(F.col("key").alias("_key"), parts), "shared")
    met = keyed.join(shared, F.col("key") == F.col("_key")).select("node", F.explode(_part_keys("key")).alias("key"))
    rows = written(met, "met").join(classes.select("node", "sig"), "node").select("key", "node", "sig")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_grouped(agreeing), "u bigint, v bigint")


def similar_links(classes: DataFrame, texts: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """(u, v): edges between nodes of classes(node, sig, first_id, k1, k2) that connect those whose shingle sets are that similar.

    Candidates are grouped by what connects them, and every pair of a group is verified on the sets.  texts has (first_id, k1, k2, text).
    A group of over MEMBERS texts is dealt to parts, and each two parts are compared together."""
    found = component_labels(candidate_links(classes)).withColumnRenamed("id", "node")
    found = written(found, "candidates")
    parts = written(found.groupBy("label").agg(F.ceil(F.count("*") / MEMBERS).cast("bigint").alias("parts")), "parts")
    found = written(classes.drop("fp", "sig").join(found, "node").join(parts, "label"), "candidates")
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}")) for k in ("first_id", "k1", "k2")]
    chosen = texts.alias("t").join(found.alias("c"), same).select("c.node", "t.text").dropDuplicates(["node"])
    sets = shingle_sets(chosen, shingle_words).join(found.select("node", "label", "parts"), "node")
    sets = sets.select("node", "own", F.explode(_part_keys("label")).alias("key"))
    return sets.select("key", "node", "own").repartition("key").sortWithinPartitions("key").mapInArrow(_grouped(_exactly(similarity)), "u bigint, v bigint")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_distance: int = 3) -> DataFrame:
    """(id_col, fp, component_id): component_id is the smallest id that links reach."""
    prints = written(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min(id_col).alias("first_id")), "classes")
    labels = component_labels(links(classes.select("fp"), max_distance))
    named = classes.join(labels.withColumnRenamed("id", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = written(named, "named")
    lowest = written(named.groupBy("label").agg(F.min("first_id").alias("component_id")), "lowest")
    members = written(named.join(lowest, "label").select("fp", "component_id"), "members")
    return prints.join(members, "fp").select(id_col, "fp", "component_id")


def near_classes(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, max_distance: int, similarity: float) -> DataFrame:
    """(first_id, k1, k2, label): a row for each different text, its smallest id, and the label of its component.

    Texts are linked by fingerprints within max_distance or by shingle sets of that Jaccard similarity."""
    prints = written(fingerprints(docs, id_col, text_col, shingle_words, True), "fingerprints")
    classes = prints.groupBy("k1", "k2").agg(F.min(id_col).alias("first_id"), F.min("fp").alias("fp"), F.min("sig").alias("sig"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    heads = written(classes.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    equal = classes.join(heads, "fp").where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    near = links(heads.select("fp"), max_distance)
    for end in ("u", "v"):
        near = near.join(heads.withColumnRenamed("fp", end), end).drop(end).withColumnRenamed("head", end)
    texts = docs.select(F.col(id_col).alias("first_id"), F.col(text_col).alias("text"), *text_key(text_col))
    edges = equal.unionByName(near).unionByName(similar_links(classes, texts, shingle_words, similarity))
    labels = component_labels(edges).withColumnRenamed("id", "node")
    named = classes.select("node", "first_id", "k1", "k2").join(labels, "node", "left")
    return named.select("first_id", "k1", "k2", F.coalesce("label", "node").alias("label"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, max_distance: int = 3, similarity: float = 0.8) -> DataFrame:
    """One row of docs of each component: that with the smallest id, null ids last; of rows with one id, one of the least text_key().

    Rows are told apart by id and text, so neither a null nor a repeated id takes another text along."""
    found = near_classes(docs, id_col, text_col, shingle_words, max_distance, similarity)
    key = F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", "k1", "k2")
    kept = written(found.groupBy("label").agg(F.min(key).alias("key")).select("key.first_id", "key.k1", "key.k2"), "kept")
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("first_id"), *text_key(text_col))
    same = [rows[k].eqNullSafe(kept[k]) for k in ("first_id", "k1", "k2")]
    return rows.join(kept, same, "left_semi").dropDuplicates(["first_id", "k1", "k2"]).select("doc.*")
