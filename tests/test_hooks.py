"""Model hooks: the right model every time, prefixes, and the cut before the fold."""

import pytest

from paraforge.functions import text as T
from paraforge.operators import infer as H
from paraforge.operators import pairs as P
from paraforge.plans import requests as R


def test_alternating_hooks_get_their_own_model(spark):
    df = spark.createDataFrame([(str(i), "a b c d e f g h i j") for i in range(4)], "sentence_id string, original string").repartition(4)
    for i in range(40):
        n = 1 + i % 7
        assert H.generate_candidates(df, H.drop_word_generator(n)).count() == 4 * n
    assert len(H._HELD) <= 1


def test_prefix_is_seen_by_the_model_only(spark):
    def upper():
        def fn(pdf):
            import pandas as pd
            return pd.DataFrame({"text": pdf["text"], "corrected": pdf["text"].str.upper()})
        return fn
    df = spark.createDataFrame([("one two",), ("  ",)], "text string")
    got = {r.text: r.corrected for r in H.correct_texts(df, upper, prefix=T.GRAMMAR_PREFIX).collect()}
    assert got == {"one two": "GRAMMAR: ONE TWO", "  ": "  "}


def test_predictions_are_cut_before_they_are_folded(spark):
    def predictor():
        def fn(pdf):
            import pandas as pd
            rows = [(m, "Glad", 0.9) for m in pdf["masked"]]
            rows += [(m, f"t{i}", 0.5 - i * 1e-3) for m in pdf["masked"] for i in range(150)]
            rows += [(m, "glad", 0.0001) for m in pdf["masked"]]
            return pd.DataFrame(rows, columns=["masked", "token", "score"])
        return fn
    df = spark.createDataFrame([("r", "I am [MASK]")], "request_id string, masked string")
    got = {r.token: r.score for r in H.predict_masked(df, predictor).collect()}
    assert len(got) == 100 and got["glad"] == 0.9


def test_corrections_are_found_by_text(spark):
    def reversed_rows():
        def fn(pdf):
            import pandas as pd
            return pd.DataFrame({"text": pdf["text"], "corrected": pdf["text"] + "."}).iloc[::-1]
        return fn
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "a", " ", "c"])], "request_id long, text string").coalesce(1)
    out = R.grammar_requests(df, reversed_rows)
    assert out.schema["request_id"].dataType.simpleString() == "bigint"
    assert {r.request_id: r.corrected for r in out.collect()} == {0: "a.", 1: "b.", 2: "a.", 3: " ", 4: "c."}


def test_short_builds_raise(spark):
    rows = [(i, f"w{i} a b c d e", f"x{i} a b c y z", 1) for i in range(30)]
    df = spark.createDataFrame(rows, "ord long, question1 string, question2 string, label int")
    with pytest.raises(ValueError):
        P.build_pairs_v4(df)
    assert P.build_pairs_v4(df, counts=None).groupBy("split").count().count() == 3
    assert P.build_pairs_v2(df, counts=None).count() == 30


def test_a_prefix_holds_the_first_rows(spark):
    reads = []
    every = spark.range(5000).selectExpr("id AS ord", "id % 10 = 3 AS good")

    def rows(bound):
        reads.append(bound)
        return every.filter(f"ord < {bound}")
    for n, total in [(5, 5000), (40, 5000), (700, 5000), (3, 0)]:
        reads.clear()
        got = [r.ord for r in P.first_n_of_prefix(P.Prefix(rows, total), lambda df: df.filter("good"), n).orderBy("ord").collect()]
        assert got == [i for i in range(total) if i % 10 == 3][:n]
        assert reads[-1] <= min(total, max(P.GROWTH * n, P.GROWTH * 10 * n))
    rows = [(i, f"w{i} a b c d e", f"x{i} a b c y z", 1) for i in range(90)]
    pairs = spark.createDataFrame(rows, "ord long, question1 string, question2 string, label int")
    lists = spark.createDataFrame([(i, f"w{i} a b c d e", f"['x{i} a b c y z']", "sentence") for i in range(50)],
                                  "ord long, text string, paraphrases string, category string")
    pre = [P.Prefix(lambda b, df=df: df.filter(df.ord < b), n) for df, n in ((pairs, 90), (lists, 50))]
    for dedupe in (False, True):
        whole, first = (P.build_pairs_v5(*s, target=4, dedupe=dedupe) for s in ((pairs, lists), pre))
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, first.collect()))
        assert whole.count() == (4 if dedupe else 8)


def test_candidates_are_made_in_slices(spark, monkeypatch):
    """A generator never gets a whole batch of long texts at once, and the answers do not depend on the slices."""
    from paraforge.plans import requests as R

    texts = [f"word{i} " + "some words that are long " * 40 for i in range(30)] + [None, "", "One two. Three four."]
    df = spark.createDataFrame(list(enumerate(texts)), "request_id long, text string").coalesce(1)

    def small():
        inner = H.drop_word_generator(8)()

        def fn(pdf):
            assert pdf["text"].str.len().sum() <= 3_000
            return inner(pdf)
        return fn

    want = [sorted(map(str, job(df, H.drop_word_generator(8)).collect())) for job in (R.paraphrase_requests, R.paragraph_requests)]
    monkeypatch.setattr(R, "SLICE_CHARS", 1_000)
    assert sorted(map(str, R.paraphrase_requests(df, small).collect())) == want[0]
    folder = str(df.sparkSession.conf.get("spark.checkpoint.dir")) + "/slices-in"
    df.write.mode("overwrite").parquet(folder)
    stream = spark.readStream.schema(df.schema).parquet(folder)
    from paraforge.streaming import requests as ST

    out = ST.run_stream(spark, stream, lambda s: R.paragraph_requests(s, small), name="slices")
    assert sorted(map(str, spark.read.parquet(out).collect())) == want[1]


def test_vectors_meet_by_position(spark):
    items = [(1, 0, "a b"), (1, 1, "a"), (1, 1, "b"), (1, 3, "a b"), (2, 0, "a"), (2, 9, "a")]
    df = spark.createDataFrame(items, "g long, pos long, sentence string")
    vectors = H.embed_texts(df.withColumnRenamed("sentence", "text"), H.hashed_bow_embedder(8))
    got = sorted((r.g, r.pos, r.step, round(r.similarity, 6)) for r in H.follower_similarity(df, vectors, 2, "g").collect())
    known = {r.text: r.vec for r in vectors.collect()}

    def cos(x, y):
        u, v = known[x], known[y]
        return round(sum(p * q for p, q in zip(u, v)) / (sum(p * p for p in u) * sum(q * q for q in v)) ** 0.5, 6)
    want = sorted((g, p, q - p, cos(s, t)) for g, p, s in items for h, q, t in items if g == h and 1 <= q - p <= 2)
    assert got == want and len(got) == 4
