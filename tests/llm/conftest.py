import random

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

DOCS = T.StructType([T.StructField(n, t) for n, t in [
    ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()),
    ("n_chars", T.LongType()), ("id", T.StringType()), ("t", T.StringType()), ("n", T.LongType()), ("fp", T.LongType()),
    ("part", T.IntegerType()), ("hits", T.StringType())]])


def rows(pairs):
    """Document rows whose further columns clash with names the operators use inside."""
    return [(i, t, "en", None, None if t is None else len(t), "x", "y", 7, 9, 3, "z") for i, t in pairs]


def edge_texts():
    rnd = random.Random(5)
    words = "the of and a in to is café naïve über straße 42 Idiot x".split()
    body = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared = body(40)
    pairs = [(7, None), (3, ""), (9, "   \n\t"), (4, "one"), (5, "one two"), (5, "one two"), (None, "a null id"), (None, None),
             (11, "é" * 3000), (12, "x" * 70000), (13, body(6000)), (14, shared), (15, shared), (16, shared.upper()),
             (17, body(5) + " " + shared + " " + body(5)), (18, "aaa bbb\n\nccc\r\n ddd  eee "), (2, "😀 emoji 中文 text"),
             (20, "tab\tand\x0bvt  nbsp ▁ low line")]
    pairs += [(100 + i, body(rnd.randint(1, 120))) for i in range(40)]
    return pairs


@pytest.fixture()
def edge_docs(spark):
    return spark.createDataFrame(rows(edge_texts()), DOCS).repartition(3)


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
