"""Small tables with every awkward row: nulls, empty and long texts, repeats, columns with clashing names."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def awkward(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "x " * 20_000, "en", "s", 40_000), (4, "same words here", "en", "s", 15), (4, "same words here", "en", "s", 15), (None, "no id", "en", "s", 5), (5, "  \n\t", "fr", "s", 4), (6, "😀é中", None, "s", 3)]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """Extra columns with names that operators use inside."""
    names = ("n", "key", "score", "spans", "node", "copies", "count", "digest", "win", "ids", "_marks", "media", "payload", "coverage", "k", "at", "h1")
    return df.select("*", *[F.lit(7).alias(c) for c in names])


def empty(spark):
    return awkward(spark).where("false")


def rows(df, *names):
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
