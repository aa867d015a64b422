"""Token files and SentencePiece against the libraries."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from paraforge.llm import sentencepiece_scan as sp
from paraforge.llm import token_files
from paraforge.llm.pieces import byte_level_encoder
from paraforge.llm.words import slices
from paraforge.session import scratch_path

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def bpe():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def odd_texts(n, seed):
    rng = random.Random(seed)
    letters = list("abst'relvmd  \n\t.-\u0085\u00e9\u00b2\u65e5\U0001f600\u2019\u0301\x1c\u200b\u2581") + ["'s", "'re", "  ", "the "]
    return ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(n)] + ["", None, "<|endoftext|>", " ", "a\u2581b"]


def test_byte_level_pieces_equal_the_library(bpe):
    texts = odd_texts(1500, 1)
    encoder = byte_level_encoder(BPE)
    for at, data, off in slices(pa.array(texts), 2000):
        ids, counts = encoder.ids(data, off)
        edge = np.concatenate([[0], np.cumsum(counts)])
        for i in range(len(counts)):
            assert ids[edge[i]:edge[i + 1]].tolist() == bpe(texts[at + i]), texts[at + i]


def test_added_tokens_get_their_ids_as_in_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    encoder, mark, rng = byte_level_encoder(BPE, added_tokens=True), "<|endoftext|>", random.Random(4)
    texts = ["a <|endoftext|> b", mark, mark * 2, f"x{mark}'s", f"  {mark}\n\n", "<|endoftext", "|>", f"<{mark}>", "", "plain"]
    texts += ["".join(rng.choices([mark, " ", "a", "\n", "'s", "\u65e5", "<|endof", "text|>", "\u00e9"], k=9)) for _ in range(300)]
    for at, data, off in slices(pa.array(texts), 2000):
        ids, counts = encoder.ids(data, off)
        edge = np.concatenate([[0], np.cumsum(counts)])
        for i in range(len(counts)):
            assert ids[edge[i]:edge[i + 1]].tolist() == library.encode(texts[at + i], add_special_tokens=False).ids, texts[at + i]


def test_files_hold_the_ids_of_added_tokens(spark):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "c")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in token_files.token_file_rows(docs, scratch_path(spark, "t"), BPE).collect()}
    ids = np.array([64, 220, 50256, 275, 0], dtype="<u4")
    assert (got[1]["n_tokens"], got[1]["ids_crc32"], got[2]["start"]) == (5, zlib.crc32(ids.tobytes()), 5)


def test_files_hold_every_document_in_order(spark, edge_docs, edge_rows, no_docs, bpe):
    got = token_files.token_file_rows(edge_docs, scratch_path(spark, "t"), BPE).collect()
    rows = sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    expected, start = [], 0
    for doc_id, text in rows:
        ids = bpe(text) + [0]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    assert token_files.token_file_rows(no_docs, scratch_path(spark, "t"), BPE).count() == 0


def test_single_documents_are_read_alone(spark, edge_docs, edge_rows, bpe, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_BYTES", 512)
    manifest = token_files.write_token_files(edge_docs.coalesce(1), scratch_path(spark, "t"), BPE).collect()
    texts = dict(edge_rows)
    found = {}
    for m in manifest:
        for doc_id, ids in token_files.read_documents(m["file"], [12, 16, 2, 999]):
            found[doc_id] = ids.tolist()
    assert found == {i: bpe(texts[i]) + [0] for i in (12, 16, 2)}


def test_damage_is_noticed(tmp_path):
    path = tmp_path / "x.ids.zst"
    with open(path, "wb") as f:
        writer = token_files.TokenFileWriter(f, 2)
        writer.add([1, 2], np.arange(200, dtype=np.uint32), np.array([150, 50]))
        writer.close()
    assert [i for i, _ in token_files.read_documents(str(path))] == [1, 2]
    raw = bytearray(path.read_bytes())
    raw[20] ^= 1
    path.write_bytes(raw)
    with pytest.raises(Exception):
        list(token_files.read_documents(str(path)))
    path.write_bytes(raw[:-3])
    with pytest.raises(ValueError):
        list(token_files.read_documents(str(path)))


def test_units_equal_the_library():
    vocab, texts = sp.vocabulary(PIECES), odd_texts(1500, 2)
    for at, data, off in slices(pa.array(texts), 3000):
        ids, counts = sp.encode_slice(vocab, data, off)
        decoded = sp.Decoder(vocab).texts(ids, counts)
        edge = np.concatenate([[0], np.cumsum(counts)])
        for i in range(len(counts)):
            text = texts[at + i] or ""
            assert ids[edge[i]:edge[i + 1]].tolist() == vocab.model.encode(text), text
            assert decoded[i].decode() == text.replace("\u2581", " ")


@pytest.mark.parametrize("chunk", [17, 40])
def test_scan_over_chunks_equals_the_library(chunk):
    vocab = sp.vocabulary(PIECES)
    rng = random.Random(3)
    texts = [t for t in odd_texts(300, 4) if t] + [rng.choice("a- =\u2581\u00e9") * rng.randrange(1, 150) for _ in range(40)]
    texts += ["".join(rng.choices("thereingationsould", k=150)) for _ in range(40)]
    for text in texts:
        parts = sp.split_chunks(text, chunk, vocab.longest)
        found = [sp.transfer(vocab, t, a, z) for _, t, a, z in parts]
        chosen = sp.choose_states([m for _, _, m in found])
        ids = []
        for (_, t, a, z), (ins, outs, _), i, o in zip(parts, found, chosen[:-1], chosen[1:]):
            ids += sp.backtrace(vocab, t, a, z, ins[i], outs[o])
        assert ids == vocab.model.encode(text), text


def test_giant_documents_in_spark(edge_docs, edge_rows, no_docs):
    vocab = sp.vocabulary(PIECES)
    rows = sp.encode(edge_docs, PIECES, giant=200, chunk=90).collect()
    assert len(rows) == len(edge_rows)
    for r in rows:
        assert r["ids"] == vocab.model.encode(r["text"] or "")
    assert sp.encode(no_docs, PIECES).count() == 0


def test_width_follows_the_vocabulary(spark):
    assert token_files.id_width(BPE) == 2 and token_files.id_width(BPE, 1 << 16) == 4
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    wide = token_files.write_token_files(docs, scratch_path(spark, "t"), BPE, end_id=70_000).collect()
    found = {i: ids.tolist() for m in wide for i, ids in token_files.read_documents(m["file"])}
    assert found[2] == [70_000] and found[1][-1] == 70_000 and len(found[1]) == 3
    import io

    with pytest.raises(ValueError):
        token_files.TokenFileWriter(io.BytesIO(), 2).add([1], np.array([70_000]), np.array([1]))


def test_rows_of_one_id_are_spread(spark):
    docs = spark.range(3000).selectExpr("CAST(7 AS LONG) AS doc_id", "concat('t', id * 7919 % 3000) AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the ranges are small here
    manifest = token_files.write_token_files(docs, scratch_path(spark, "t"), BPE)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert manifest.count() > 1 and manifest.agg({"n_docs": "max"}).first()[0] < 2000
