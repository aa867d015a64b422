"""The pipeline's stages on small data."""

import pytest

import __spark_entry__ as E
import corpus_pipeline
from paraforge.llm.common import stored, table

SF = "/root/testdata/sf0.001"


def test_all_operators_are_registered():
    names = E.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF), name)
        counts.append(docs.count())
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "near_dedup":
            assert counts[-1] < counts[-2]
        if name == "substring_dedup":
            old = dict(before.select("doc_id", "text").collect())
            new = dict(docs.select("doc_id", "text").collect())
            assert old.keys() == new.keys() and any(old[k] != new[k] for k in old)
    assert counts[0] == counts[1] and counts[-1] == counts[-2]

    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = dict(before.select("doc_id", "text").collect())
    for r in docs.collect():
        assert r["ids"] == model.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])


@pytest.mark.parametrize("which", ["edge_docs", "no_docs"])
def test_stages_on_edge_rows(spark, which, request):
    docs = request.getfixturevalue(which)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
    assert docs.columns == ["doc_id", "source", "lang", "n_tokens", "ids"]
    assert (docs.count() > 0) == (which == "edge_docs")


def test_language_stage_goes_by_the_classifier(spark):
    schema = "doc_id long, text string, lang string"
    rows = [(i, f"the house and the tree {i}" if i % 2 else f"das Haus und der Baum {i}", "en" if i % 2 else "de") for i in range(80)]
    rows += [(900, "\u65e5\u672c\u8a9e", None), (901, "the tree", None), (902, "12", None)]
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_id(spark, spark.createDataFrame(rows, schema), SF).collect()}
    assert got.keys() == {*range(80), 901} and got[901] == "en"
    unlabelled = spark.createDataFrame([(i, t, None) for i, t, _ in rows], schema)
    got = {r["doc_id"] for r in corpus_pipeline.language_id(spark, unlabelled, SF).collect()}
    assert got == {*range(80), 900, 901}


def test_dedup_stages_match_brute_force(spark):
    import hashlib

    from test_dedup import linked, stripped

    docs = table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert {r["doc_id"] for r in kept.collect()} == {doc_id for doc_id, _, _, stays in linked(rows) if stays}
    left = [(r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect()]
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.substring_dedup(spark, kept, SF).collect()}
    for (doc_id, _, removed, digest), n in stripped(left, 35).items():
        text = out[doc_id]
        assert n == 1 and (text == dict(left)[doc_id] if removed == 0 else hashlib.sha256(text.encode()).hexdigest() == digest)


def test_language_stage_rejects_nothing_else(spark):
    docs = table(spark, SF, "documents")
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, SF).collect()}
    for doc_id, text in docs.select("doc_id", "text").collect():
        assert (doc_id in kept) == any(c.isalpha() for c in text or ""), doc_id
