"""Source mixing invariants and language identification."""

import zlib
from collections import defaultdict

import pytest

from paraforge.llm import language, mixing
from paraforge.llm.common import table

SF = "/root/testdata/sf0.001"


def filled(sizes, cap=3.0):
    """Targets by repeated resharing, as the contract words it."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        weights = sum(weight[s] for s in sizes if s not in full)
        target = {s: cap * sizes[s] if s in full else rest * weight[s] / weights for s in sizes}
        over = {s for s in sizes if s not in full and target[s] > cap * sizes[s]}
        if not over:
            return target
        full |= over


def check_mix(rows):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    target = filled(sizes)
    total = sum(sizes.values())
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.01 * total + 50, s


def test_mix_of_the_documents(spark):
    docs = table(spark, SF, "documents", "doc_id", "text", "source")
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    check_mix(rows)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=repr)


def test_mix_of_edge_rows(edge_docs, edge_rows):
    rows = mixing.mix(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    check_mix(rows)
    assert mixing.mixed_rows(edge_docs).columns == edge_docs.columns


def test_mix_of_nothing(no_docs, edge_docs):
    assert mixing.mix(no_docs).count() == 0
    blank = edge_docs.filter("text IS NULL OR trim(text) = ''")
    assert {r["taken"] for r in mixing.mix(blank).collect()} == {0}


def test_emitted_rows_meet_the_targets(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    words = lambda df: {r["source"]: r["n"] for r in mixing.document_sizes(df).groupBy("source").agg({"size": "sum"})
                        .withColumnRenamed("sum(size)", "n").collect()}
    sizes, emitted = words(docs), words(mixing.mixed_rows(docs))
    largest = {r["source"]: r["m"] for r in mixing.document_sizes(docs).groupBy("source").agg({"size": "max"})
               .withColumnRenamed("max(size)", "m").collect()}
    for s, target in filled(sizes).items():
        assert abs(emitted.get(s, 0) - target) <= 0.01 * target + largest[s] / 2, s


def test_seats_are_sainte_lague(spark):
    votes = {"a": 53, "b": 24, "c": 23, "d": 7, "e": 1}
    seats = 17
    quotients = sorted(((v / (2 * k + 1), p) for p, v in votes.items() for k in range(seats)), reverse=True)[:seats]
    expected = {p: sum(1 for _, x in quotients if x == p) for p in votes}
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, p, v, seats) for p, v in votes.items()], "g int, p string, v long, seats long")
    got = {r["p"]: r["q"] for r in mixing.apportion(df, ["g"], "v", "seats", F.xxhash64("p"), "q").collect()}
    assert got == expected


def test_language_of_held_out_documents(spark):
    rows = language.op6_language_id(spark, "/root/testdata/sf0.01").collect()
    truth = dict(table(spark, "/root/testdata/sf0.01", "documents", "doc_id", "lang").collect())
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 100 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_edge_rows(edge_docs, edge_rows, no_docs):
    rows = language.identify(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    for r in rows:
        blank = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == blank
        assert r["score"] == 0 or not blank
    assert language.identify(no_docs).count() == 0


def test_prediction_sees_only_the_text(spark, edge_docs):
    model = language.train(edge_docs)
    a = language.predict(edge_docs.select("doc_id", "text"), model)
    from pyspark.sql import functions as F

    b = language.predict(edge_docs.select(F.lit(99).cast("long").alias("doc_id"), "text"), model)
    key = lambda df: sorted((r["text"] or "", r["lang_pred"], r["score"]) for r in df.collect())
    assert key(a) == key(b)
    none = language.predict(edge_docs, None)
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


def test_sample_is_bounded_by_different_rows(spark):
    one = next(i for i in range(1000, 1100) if not language_held(i))
    rows = [(one, f"the one and the other {chr(97 + i // 26 % 26)}{chr(97 + i % 26)}z{chr(97 + i // 40)}", "en") for i in range(900)] + [(one, "the same row", "en")] * 300 + [(i, f"der eine und der andere {i}", "de") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []

    def fit(samples, *args):
        seen.extend(samples)
        return real(samples, *args)
    real = language.fit
    language.fit = fit
    try:
        model = language.train(docs, 50)
    finally:
        language.fit = real
    assert sum(lang == "en" for lang, _ in seen) == 50 and len(seen) == 50 + sum(
        not language_held(i) for i in range(40))
    assert len({codes.tobytes() for lang, codes in seen if lang == "en"}) == 50
    assert model is not None


def language_held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


CLASH = ["_t", "text_", "_text", "_lang_pred", "_score", "lang_pred_", "_k1", "_k2", "_id", "k1", "k2", "id", "key1", "key2", "spans", "_spans", "whole", "_tie",
         "own_tie", "mix_id", "mix_tie", "mix_source", "copies", "_copies", "_n", "root", "cid", "grp", "tie", "rank"]


def test_columns_of_any_name_pass_the_stages(spark):
    import corpus_pipeline

    rows = [(i, f"the house and the tree and the road {i % 20} are here", ["en", None][i % 2], f"s{i % 3}", 40, *[f"{c}{i}" for c in CLASH]) for i in range(60)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got, name
        for r in got:
            assert all(r[c] == f"{c}{r['doc_id']}" for c in CLASH), name
    assert corpus_pipeline.sentencepiece(spark, docs, SF).count() == len(rows)


def test_taken_follows_the_blocks_of_a_plain_mix(spark):
    """The words a source gives, seat by seat: quotas by highest quotients, whole passes, then blocks in seeded order."""
    rows = [(i, "w " * (i * 37 % 90 + 1), ["a", "b", None][i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, blocks=200, shard_blocks=8).collect()
    sizes = defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len(t.split())
    target, total = filled(sizes), sum(sizes.values())
    block = max(1.0, total / 200)
    seats = round(sum(target.values()) / block)
    quota = dict.fromkeys(sizes, 0)
    for _ in range(seats):
        best = max(sizes, key=lambda s: target[s] / (2 * quota[s] + 1))
        quota[best] += 1
    taken = defaultdict(int)
    for r in got:
        taken[r["source"]] += r["taken"]
    for s in sizes:
        # a shard gives whole tokens of its blocks: at most one token a shard is lost to rounding
        shards = max(1, -(-sizes[s] // int(block * 8)))
        assert abs(taken[s] - min(quota[s] * block, 3 * sizes[s])) <= shards + 1, s
