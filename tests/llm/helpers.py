"""Fixtures of the training-data tests."""

import glob
import os

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None, langs=None, sources=None):
    """A documents table; ``texts`` may hold nulls."""
    n = len(texts)
    ids = list(range(n)) if ids is None else ids
    langs = ["en"] * n if langs is None else langs
    sources = ["s"] * n if sources is None else sources
    rows = [(i, t, l, s, None if t is None else len(t)) for i, t, l, s in zip(ids, texts, langs, sources)]
    return spark.createDataFrame(rows, DOCS)


def table(spark, name, folder=DATA):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def local_rows(name, folder=DATA):
    import duckdb

    path = f"{folder}/{name}.parquet"
    path = f"{path}/*.parquet" if os.path.isdir(path) and glob.glob(f"{path}/*") else path
    return duckdb.sql(f"SELECT * FROM '{path}'").fetchall()


ODD_TEXTS = [
    None, "", " \n\t ", "one", "a b", "a b c", "a b c d", "a b c d e", "ALPHA beta gamma delta", "é ü ñ 日本語 😀 x",
    "same words here again and again", "same words here again and again", "x " * 4000, "no\u000bbreak\u000cpage\rreturn\ttab",
    "123 456 !!! ###", "line\nline\nline\n\nother\nline",
]
