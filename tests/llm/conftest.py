import random

import pytest
from pyspark.sql import types as T

#: documents with columns whose names the operators use themselves
EDGE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()), T.StructField("k1", T.LongType()),
                     T.StructField("size", T.StringType()), T.StructField("spans", T.StringType()),
                     T.StructField("score", T.DoubleType()), T.StructField("ids", T.StringType()),
                     T.StructField("root", T.StringType())])


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edge_texts():
    """(doc_id, text) with null and empty texts, white space only, repeated rows, a null id, one very long
    text, copies, near copies, shared passages, ties and texts without letters."""
    rng = random.Random(7)
    base = words(rng, 120)
    passage = words(rng, 20)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, "12 34 -- 56"), (7, "a b c d e"),
            (8, " ".join(base)), (9, " ".join(base)), (9, " ".join(base)), (None, " ".join(words(rng, 50))), (None, None),
            (10, "  ".join(base[:60]) + "\nnew " + " ".join(base[60:])), (11, "\u00e9t\u00e9 \u65e5\u672c\u8a9e \U0001f600 \u2028x\u00a0y"),
            (12, " ".join(words(rng, 15) + passage + words(rng, 15))), (13, " ".join(words(rng, 5) + passage + words(rng, 9))),
            (14, " ".join(["same"] * 60)), (15, " ".join(words(rng, 30_000))), (16, "x" * 70_000), (17, "a\u2581b  c ")]
    for i in range(100, 140):
        copy = list(base)
        for _ in range(rng.randrange(12)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(copy)))
    rows += [(i, " ".join(words(rng, rng.randrange(1, 80)))) for i in range(200, 240)]
    return rows


@pytest.fixture(scope="session")
def edge_rows():
    return edge_texts()


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    rows = [(i, t, None if (i or 0) % 5 == 0 else ("en" if (i or 0) % 2 else "de"), None if (i or 0) % 7 == 0 else f"s{(i or 0) % 3}",
             len(t) if t is not None else None, 5, "x", "y", 0.5, "z", "q") for i, t in edge_rows]
    return spark.createDataFrame(rows, EDGE).repartition(4).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EDGE)
