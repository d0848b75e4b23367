"""URL filters: host and path rules, and a character language-model ratio.

Two variable-order Markov models, of accepted and of rejected URLs, are smoothed by
interpolation: an order's estimate is its counts plus ``WEIGHT`` pseudo-counts dealt by the next
lower order, so unseen contexts fall back by themselves.  The rules label rows.  One labelled text in
``FOLDS``, by its MD5, is held out for calibration, and the counts come from all others; no row is sampled.  What is scored is host and path,
lower-cased; query strings and fragments, mostly session state, are left out.  Counts are exact and stay a DataFrame that grows
with the input: a window of ORDERS bytes is one number, all lower orders are sums over
windows, and the distinct windows of each batch of rows are joined to their log-ratios
and meet the batch again, so nothing is broadcast but counts by single bytes.  A URL's
score is the difference of both log-likelihoods
divided by its length; the decision threshold is calibrated on a histogram of the held-out
rows' scores, as the bin with the least mean of both error rates; where a class has none held out, it is 0.

Defined cases: a null URL or one without ``://`` has empty host and path, no rule and, as it has no
characters to score, the verdict allow; without rows of either class all unruled URLs are
allowed; repeated rows each get a row; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, written

# The rules of the contract, as (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
ORDERS, WEIGHT = 6, 2.0  # a window of ORDERS bytes and its slot fit in 64 bits
FOLDS = 10
BATCH_BITS = 11  # rows scored together, as a power of two
BINS, REACH = 400, 4.0  # of the score histogram, which holds -REACH to REACH


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):  # longer rules override
        own, start = text.split("/", 1)[0], "/" + text.split("/", 1)[1]
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of all characters of all texts: the ORDERS bytes that end there as a number, and the text's number.

    A text begins with ORDERS - 1 zero bytes as its first contexts."""
    pad = b"\0" * (ORDERS - 1)
    raw = np.frombuffer(b"".join(pad + t for t in texts), dtype=np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) + ORDERS - 1 for t in texts])
    inside = np.concatenate([np.r_[np.zeros(ORDERS - 1, bool), np.ones(len(t), bool)] for t in texts]) if texts else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    windows = np.zeros(len(at), np.int64)
    for back in range(ORDERS):
        windows |= raw[at - back] << 8 * back
    return windows, owner[at]


def _texts(column: pa.Array) -> list[bytes]:
    return [(t.as_py() or "").lower().encode() for t in column]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, rejected): the counts of each window in accepted and in rejected texts."""
    for batch in batches:
        windows, owner = _windows(_texts(batch.column(0)))
        rejected = np.array(batch.column(1).to_pylist(), dtype=bool)[owner]
        names, which = np.unique(windows, return_inverse=True)
        counts = [np.bincount(which[rejected == c], minlength=len(names)).astype(np.int64) for c in (False, True)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (names, *counts)], names=["window", "accepted", "rejected"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (batch, text): the distinct windows of each batch."""
    for rows in batches:
        windows, owner = _windows(_texts(rows.column(1)))
        of = rows.column(0).to_numpy(zero_copy_only=False)[owner]
        pairs = np.unique(np.stack([of, windows]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["batch", "window"])


def _slots(window: Column) -> list[Column]:
    """The keys of a window's counts: of its context and of context + character per order, with their slot above the bytes."""
    out = []
    for order in range(ORDERS):
        for bytes_, value in ((order, F.shiftright(window, 8)), (order + 1, window)):
            out.append(value.bitwiseAND(F.lit((1 << 8 * bytes_) - 1)) + F.lit(len(out) << 8 * ORDERS))
    return out


def log_ratios(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, ratio): of distinct windows the log-probability of its character by the accepted less that by the rejected.

    counts has (window, accepted, rejected)."""
    classes = ("accepted", "rejected")
    keyed = counts.select(F.explode(F.array(*_slots(F.col("window")))).alias("key"), *classes)
    sums = written(keyed.groupBy("key").agg(*[F.sum(c).alias(c) for c in classes]), "sums")
    slots, few = _slots(F.col("window")), 3  # the first three have 513 keys at most, which any window asks for
    asked = windows.select("window", F.explode(F.array(*slots[few:])).alias("key")).join(sums.where(F.col("key") >= few << 8 * ORDERS), "key")
    slot = F.shiftright(F.col("key"), 8 * ORDERS)
    more = asked.groupBy("window").agg(*[F.sum(F.when(slot == k, F.col(c))).alias(f"{c}{k}") for k in range(few, 2 * ORDERS) for c in classes])
    found = windows.join(more, "window", "left")
    for k in range(few):
        part = sums.select(F.col("key").alias("_key"), *[F.col(c).alias(f"{c}{k}") for c in classes]).where(F.shiftright("_key", 8 * ORDERS) == k)
        found = found.join(F.broadcast(part), slots[k] == F.col("_key"), "left").drop("_key")
    found, logs = found.fillna(0), []
    for c in classes:
        p = F.lit(1 / 256)
        for order in range(ORDERS):
            p = (F.col(f"{c}{2 * order + 1}") + WEIGHT * p) / (F.col(f"{c}{2 * order}") + WEIGHT)
        logs.append(F.log(p))
    return found.select("window", (logs[0] - logs[1]).alias("ratio"))


def _score(rows: pa.Table, known: pa.Table) -> pa.Table:
    """The rows of one batch with the mean ratio of their windows; known has (batch, window, ratio)."""
    windows, owner = _windows(_texts(rows["_text"]))
    names, first = np.unique(known["window"].to_numpy(), return_index=True)
    ratios = known["ratio"].to_numpy()[first][np.searchsorted(names, windows)] if len(windows) else np.zeros(0)
    sums, sizes = np.bincount(owner, ratios, rows.num_rows), np.bincount(owner, minlength=rows.num_rows)
    return rows.append_column("score", pa.array(sums / np.maximum(sizes, 1), pa.float64()))


def cut_of(histogram: np.ndarray) -> float:
    """The score below which the mean of both error rates is least, the middle one of equals; rows are accepted, then rejected."""
    share = histogram.cumsum(axis=1) / histogram.sum(axis=1, keepdims=True)
    error = np.r_[1.0, share[0] + 1 - share[1]]  # accepted ones below the cut, rejected ones above it
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return -REACH + best[len(best) // 2] * 2 * REACH / BINS


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id_col, host, path, rule, score, verdict) per row; score is null where a rule decides."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(F.col(id_col), F.col(url_col).alias("_url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("_ruled", verdict).withColumn("_text", F.concat("host", "path"))
    rows = rows.select("_text", "_ruled", F.col(id_col).alias("_id"), "host", "path", "rule", F.shiftright(F.monotonically_increasing_id(), BATCH_BITS).alias("batch"))
    rows = written(rows, "urls")
    rejected = F.col("_ruled") == "block"

    held = F.conv(F.substring(F.md5("_text"), 1, 7), 16, 10).cast("bigint") % FOLDS == 0
    counts = rows.where(F.col("_ruled").isNotNull() & ~held).select("_text", rejected.alias("rejected")).mapInArrow(_count, "window bigint, accepted bigint, rejected bigint")
    counts = written(counts.groupBy("window").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), "counts")
    asked = written(rows.select("batch", "_text").mapInArrow(_asked, "batch bigint, window bigint"), "asked")
    ratios = written(log_ratios(asked.select("window").distinct(), counts), "ratios")
    known = asked.join(ratios, "window").select("batch", "window", "ratio")
    scored = rows.groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(_score, rows.withColumn("score", F.lit(0.0)).schema)
    scored = written(scored, "scored")

    totals = counts.agg(F.sum("accepted"), F.sum("rejected")).first()
    both, threshold = bool(totals[0] and totals[1]), 0.0
    if both:
        marked = scored.where(F.col("_ruled").isNotNull() & held).select(rejected.cast("int").alias("rejected"), "score")
        place = F.least(F.greatest(F.floor((F.col("score") + REACH) * (BINS / (2 * REACH))), F.lit(0)), F.lit(BINS - 1))
        histogram = np.zeros((2, BINS))
        for r in marked.groupBy("rejected", place.alias("bin")).count().collect():  # 2 * BINS rows at most
            histogram[r["rejected"], r["bin"]] = r["count"]
        if histogram.sum(axis=1).all():
            threshold = cut_of(histogram)
    judged = F.when(F.col("_ruled").isNotNull(), F.col("_ruled")).when(F.lit(both) & (F.col("_text") != "") & (F.col("score") < threshold), "block").otherwise("allow")
    return scored.select(F.col("_id").alias(id_col), "host", "path", "rule", F.when(F.col("_ruled").isNull(), F.col("score")).alias("score"), judged.alias("verdict"))
