import pandas as pd

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with names that operators use themselves.
CLASH = ["id", "fp", "g", "th", "runs", "words", "row", "token", "_id", "_kept", "first", "label"]


def docs(spark, texts, extra=False):
    rows = [(n, t, "en", "s", len(t or "")) for n, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        frame = frame.select("*", *[F.lit(1).alias(c) for c in CLASH])
    return frame


def by_id(frame, key="doc_id") -> dict:
    return {r[key]: r.asDict() for r in frame.collect()}


ODD = [None, "", " \n\t ", "a", "The quick brown fox. " * 3, "x" * 5000, "Ünïcode ß 日本 " * 40, "The quick brown fox. " * 3, "w " * 3000]


def missing(v) -> bool:
    return v is None or v is pd.NA or v != v
