"""Quality rules with SQL functions only: repetition counts and distribution divergence.

Each text gives two histograms: of character classes and of common words of its
language.  A language's reference is the mean histogram over its texts that pass the base rules, gathered from
all rows, so it has one row per language.  All counts are made once and written, the
references come from that table, and the verdicts from it and them.  A text
is rejected if the Jensen-Shannon distance (square root of the divergence, base 2) to its
language's reference is over the limit in either histogram, guarded by minimum lengths, or if
the base rules reject it.

Repeated 8-word windows are found inside the row: window hashes are sorted with
their places and the places of equal neighbours are merged to covered words, so no
window travels.

Defined cases: null text has no words and fails the base rules; rows without a language share a reference;
a language without common words in COMMON is judged by its character classes alone; a distance is null, and its rule
passes, where a text is below the minimum length or its language has no text that the reference could be made of; repeated
rows each get a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ASCII_SPACE, written

SPACE_RUN = "[ \\t-\\r]+"
# Character classes.
SYMBOLS, PUNCTUATION = "[#*$%&|<>]", "[.,;:!?'\"()-]"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Least words before a histogram counts, and the largest distance that is kept.
MIN_CLASS_WORDS, MIN_COMMON_WORDS = 30, 200
MAX_CLASS_DISTANCE, MAX_COMMON_DISTANCE = 0.35, 0.24
#: References (some 300 bytes each) up to which every task gets them.
MOST_LANGUAGES = 10_000
# Frequent function words of the languages.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "with", "this"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist", "nicht", "ein", "auf", "für"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "qui", "est", "pour"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para"],
}


def _among(text: Column, characters: str) -> Column:
    """How many of text's characters match a character class."""
    return F.regexp_count(text, F.lit(characters))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def _held(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is computed once per row.

    The optimizer moves plain expressions into whatever uses them, lambdas and filters too, which would run them once
    for each element; it never moves a generator's output."""
    return rows.select("*", F.explode_outer(F.array(value)).alias(name))


def _class_counts(joined: Column) -> Column:
    """Of the characters in words: ASCII capitals, digits, punctuation, symbols, other ASCII characters, and all others."""
    counts = [_among(joined, g) for g in ("[A-Z]", "[0-9]", PUNCTUATION, SYMBOLS)]
    wide = F.length(F.regexp_replace(joined, r"[\x00-\x7F]+", ""))
    rest = F.length(joined) - wide - reduce(lambda a, b: a + b, counts)
    return F.array(*[c.cast("double") for c in [*counts, rest, wide]])


def _common(words: Column, lang: Column) -> Column:
    """Those of the words that are common ones of the language; null for other languages."""
    def among(own: list[str]):
        return lambda w: w.isin(*own)

    picked = [F.when(lang == name, F.filter(words, among(own))) for name, own in COMMON.items()]
    return F.coalesce(*picked)


def _common_counts(common: Column, lang: Column) -> Column:
    """How often each common word of the language stands among them."""
    def count(word: str) -> Column:
        return F.size(F.filter(common, lambda w: w == word)).cast("double")

    counts = [F.when(lang == name, F.array(*[count(x) for x in own])) for name, own in COMMON.items()]
    return F.coalesce(*counts)


def _share(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda c: F.when(total > 0, c / total).otherwise(0.0))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares; null if one is."""

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    parts = F.zip_with(p, q, lambda a, b: 0.5 * term(a, b) + 0.5 * term(b, a))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.when(total.isNotNull(), F.sqrt(F.greatest(total, F.lit(0.0))))


def _inner(docs: DataFrame) -> list[str]:
    """Names for docs' columns that clash with none of ours."""
    return [f"_d{i}" for i in range(len(docs.columns))]


def histograms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs' columns under inner names with words, lang, word_chars, n_symbols and both histograms."""
    own = dict(zip(docs.columns, _inner(docs)))
    text, lang = F.coalesce(F.col(own[text_col]), F.lit("")), F.col(own[lang_col])
    rows = _held(docs.toDF(*own.values()), "words", _words(text)).withColumn("lang", lang)
    rows = _held(rows, "joined", F.array_join("words", ""))
    rows = rows.withColumn("word_chars", F.length("joined").cast("bigint"))
    rows = _held(rows, "classes", _class_counts(F.col("joined")))
    rows = _held(rows, "picked", _common(F.col("words"), lang))
    rows = _held(rows, "common", _common_counts(F.col("picked"), lang))
    n_words = F.size("words").cast("bigint")
    total = F.aggregate("classes", F.lit(0.0), lambda s, x: s + x)
    seen = F.aggregate("common", F.lit(0.0), lambda s, x: s + x)
    other = F.greatest(F.lit(0.0), 1 - F.when(n_words > 0, seen / n_words).otherwise(0.0))
    rows = rows.withColumn("n_words", n_words).withColumn("n_symbols", F.col("classes")[3].cast("bigint"))
    rows = _held(rows, "p_class", _share(F.col("classes"), total))
    return _held(rows, "p_common", F.concat(_share(F.col("common"), n_words), F.array(other))).drop("joined", "classes", "picked", "common")


def measures(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """histograms() with the counts of the base rules and base_failed."""
    text = F.coalesce(F.col(dict(zip(docs.columns, _inner(docs)))[text_col]), F.lit(""))
    rows = _held(histograms(docs, text_col, lang_col), "each", F.transform("words", lambda w: F.xxhash64(w)))
    window = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW), lambda i: F.xxhash64(*[F.get("each", i + k) for k in range(WINDOW)]))
    rows = _held(rows, "hashes", F.when(F.col("n_words") >= WINDOW, window).otherwise(F.array().cast("array<bigint>")))
    paired = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = _held(rows, "paired", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), paired).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda x, j: x["h"] == F.get("paired", j)["h"]
    twice = F.filter("paired", lambda x, i: F.coalesce(same(x, i - 1), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False)))
    rows = _held(rows, "places", F.sort_array(F.transform(twice, lambda x: x["i"])))
    first = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate("places", first, lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])
    rows = _held(rows, "lines", F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(ASCII_SPACE)) != ""))
    rows = _held(rows, "n_repeat_words", covered.cast("bigint"))
    rows = _held(rows, "n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed).drop("words", "each", "hashes", "paired", "places", "lines")


def references(measured: DataFrame) -> DataFrame:
    """(ref_lang, q_class, q_common): mean histograms over the texts of each language that pass the base rules."""
    n_class, n_common = 6, len(COMMON["en"]) + 1
    rows = measured.where("not base_failed")
    rows = rows.withColumn("p_class", F.when(F.col("n_words") >= MIN_CLASS_WORDS, F.col("p_class"))).withColumn("p_common", F.when(F.col("n_words") >= MIN_COMMON_WORDS, F.col("p_common")))
    sums = [F.avg(F.get("p_class", F.lit(i))).alias(f"c{i}") for i in range(n_class)]
    sums += [F.avg(F.get("p_common", F.lit(i))).alias(f"w{i}") for i in range(n_common)]
    means = rows.groupBy(F.col("lang").alias("ref_lang")).agg(*sums)
    known = lambda first, names: F.when(F.col(first).isNotNull(), F.array(*names))
    return means.select("ref_lang", known("c0", [f"c{i}" for i in range(n_class)]).alias("q_class"), known("w0", [f"w{i}" for i in range(n_common)]).alias("q_common"))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """The columns carry (or all) of docs under ``doc``, counts, both distances (null where a guard holds) and kept."""
    own = dict(zip(docs.columns, _inner(docs)))
    measured = measures(docs, text_col, lang_col)
    measured = measured.select(F.struct(*[F.col(own[name]).alias(name) for name in carry or docs.columns]).alias("doc"), *[c for c in measured.columns if c not in own.values()])
    measured = written(measured, "measures")
    refs = written(references(measured), "references")
    if refs.count() <= MOST_LANGUAGES:  # else Spark's own choice, which splits a language's rows
        refs = F.broadcast(refs)
    found = measured.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    class_distance = F.when(F.col("n_words") >= MIN_CLASS_WORDS, distance(F.col("p_class"), F.col("q_class")))
    common_distance = F.when(F.col("n_words") >= MIN_COMMON_WORDS, distance(F.col("p_common"), F.col("q_common")))
    found = found.withColumn("class_distance", class_distance).withColumn("common_distance", common_distance)
    ok = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASS_DISTANCE) & (F.coalesce("common_distance", F.lit(0.0)) <= MAX_COMMON_DISTANCE)
    found = found.withColumn("kept", ~F.col("base_failed") & ok)
    return found.select("doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "common_distance", "kept")


def keep(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that the rules keep."""
    return judge(docs, text_col, lang_col).where("kept").select("doc.*")
