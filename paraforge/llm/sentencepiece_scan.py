"""SentencePiece (BPE) encoding and decoding, giant documents in parallel chunks.

A text is normalised as the model does it (one leading space, spaces written as U+2581) and falls into
units at each space after another character; no piece of the vocabulary runs over the start of a unit, so
documents of up to ``GIANT`` characters are encoded unit by unit with the library and a bounded memo.

Longer documents are cut into chunks of ``CHUNK`` characters wherever the cuts fall, each with a margin of one piece
length. Tokens that may lie around a cut are its boundary states. A token sequence is the BPE encoding
exactly if each two neighbouring tokens are the encoding of their joined text, so a path through the lattice
of pieces scores 0 if all neighbours fit, else minus infinity, and the best path is the encoding. Each chunk
yields the max-plus matrix of best scores between the states at its two ends. Matrices are combined associatively by a
scan over the chunks of a document, forwards and backwards, which fixes the state at every cut; then each chunk
is backtraced independently between its two states. Inside a chunk only the units that touch its ends go through the lattice,
or the whole chunk if it holds no start of a unit.

Null and empty texts give no tokens. Rows are told apart by their text only, so null or repeated ids and repeated
rows are fine; an empty table gives an empty result. Decoding joins the pieces and gives the
text back, with U+2581 as a space, as the library does.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraforge.llm.common import stored, table, text_key
from paraforge.llm.pieces import PieceEncoder
from paraforge.llm.words import slices

GIANT = 1 << 15
CHUNK = 1 << 14
SPACE = "▁"  # fixed value: the model's sign for a space
NEVER = float("-inf")


class Vocabulary:
    """The pieces of a BPE model, its merge order, and which tokens may stand next to each other."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.rank, self.bytes_of = {}, {}, []
        self.byte_ids = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes_of.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.ids[piece], self.rank[piece] = i, model.get_score(i)
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.ids))
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece of this model runs over the start of a word")
        self.encoder = PieceEncoder(self._encode_unit, unit_starts)
        self.fits = lru_cache(maxsize=1 << 18)(self._fits)

    def _encode_unit(self, unit: str) -> list[int]:
        """A unit starts with a space; the library puts one before what it is given."""
        return self.model.encode(unit[1:]) if len(unit) > 1 else [self.ids[SPACE]]

    def token_ids(self, token: str) -> list[int]:
        found = self.ids.get(token)
        return [found] if found is not None else [self.byte_ids[b] for b in token.encode()]

    def merge(self, text: str) -> list[str]:
        """The model's merges on a short text: the best-ranked neighbours first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.rank.get(parts[i] + parts[i + 1], NEVER), -i))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _fits(self, left: str, right: str) -> bool:
        return self.merge(left + right) == [x for x in (left, right) if x]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def unit_starts(codes: np.ndarray, off: np.ndarray) -> np.ndarray:
    white = (codes == 32) | (codes == ord(SPACE))
    start = white.copy()
    start[1:] &= ~white[:-1]
    start[off[:-1][off[:-1] < len(codes)]] = True
    return np.flatnonzero(start)


def with_leading_space(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    some = np.diff(off) > 0
    return (np.insert(data, off[:-1][some], 32),
            off + np.concatenate([[0], np.cumsum(some)]))


def encode_slice(vocab: Vocabulary, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a slice of texts and the number of ids of each."""
    return vocab.encoder.ids(*with_leading_space(data, off))


class Decoder:
    """Ids to text: bytes of the pieces, less the leading space."""

    def __init__(self, vocab: Vocabulary):
        self.size = np.array([len(b) for b in vocab.bytes_of], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(vocab.bytes_of), dtype=np.uint8)

    def texts(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        size = self.size[ids]
        total = np.cumsum(size)
        raw = self.flat[np.repeat(self.start[ids] - (total - size), size) + np.arange(total[-1] if len(total) else 0)].tobytes()
        edge = np.concatenate([[0], total])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a + 1:z] if raw[a:a + 1] == b" " else raw[a:z] for a, z in zip(edge[:-1], edge[1:])]


# --- chunks of giant documents ---------------------------------------------------------------------------------


def split_chunks(text: str, chunk: int, margin: int) -> list[tuple[int, str, int, int]]:
    """(number, text with margins, place of its start, place of its end) for the normalised text."""
    text = SPACE + text.replace(" ", SPACE)
    out = []
    for k, start in enumerate(range(0, len(text), chunk)):
        end = min(len(text), start + chunk)
        left = min(margin, start)
        out.append((k, text[start - left:end + margin], left, left + end - start))
    return out


def cut_states(vocab: Vocabulary, text: str, cut: int) -> list[tuple[int, int]]:
    """(start, end) of every token that starts before a cut and ends at it or after it; the ends of a
    document have the one state of a token of no length."""
    if cut in (0, len(text)):
        return [(cut, cut)]
    return [(a, z) for a in range(max(0, cut - vocab.longest), cut)
            for z in range(cut, min(len(text), a + vocab.longest) + 1)
            if z - a == 1 or text[a:z] in vocab.ids]


def lattice(vocab: Vocabulary, text: str, entries: list[tuple[int, int]], stop: int, exits=None):
    """Paths from entry tokens through tokens that fit their neighbours. Without ``exits``, tokens end by
    ``stop``; with them, the tokens that reach over ``stop`` must be exits.

    Returns {token: (set of entries as bits, one predecessor per entry)}."""
    reached = {}
    ends: dict[int, list] = {}
    for bit, token in enumerate(entries):
        reached[token] = {bit: None}
        ends.setdefault(token[1], []).append(token)
    wanted = set(exits or ())
    for at in range(min(z for _, z in entries), stop):
        lefts = ends.pop(at, None)
        if not lefts:
            continue
        for end in range(at + 1, min(len(text), at + vocab.longest) + 1):
            token = (at, end)
            if end > stop or (exits is not None and end == stop):
                if token not in wanted:
                    continue
            right = text[at:end]
            if end - at > 1 and right not in vocab.ids:
                continue
            back = {}
            for left in lefts:
                if vocab.fits(text[left[0]:left[1]], right):
                    for bit in reached[left]:
                        back.setdefault(bit, left)
            if back:
                reached[token] = back
                if end <= stop:
                    ends.setdefault(end, []).append(token)
    return reached


def trace(reached: dict, token, bit: int) -> list[tuple[int, int]]:
    """The tokens of the path from an entry to ``token``, the entry left out."""
    out = []
    while reached[token].get(bit) is not None:
        out.append(token)
        token = reached[token][bit]
    return out[::-1]


def inner_units(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The first and the last start of a unit between two cuts (places from ``start`` up to ``end`` - 1)."""
    where = [i for i in (_next_unit(text, start, end), _last_unit(text, start, end)) if i is not None]
    return (where[0], where[1]) if len(where) == 2 else None


def _is_unit(text: str, i: int) -> bool:
    return text[i] == SPACE and (i == 0 or text[i - 1] != SPACE)


def _next_unit(text, start, end):
    return next((i for i in range(start, end) if _is_unit(text, i)), None)


def _last_unit(text, start, end):
    return next((i for i in range(end - 1, start - 1, -1) if _is_unit(text, i)), None)


def _at_unit(place: int) -> list[tuple[int, int]]:
    return [(place, place)]


def transfer(vocab: Vocabulary, text: str, start: int, end: int):
    """States at both ends of a chunk (as offsets from the cut) and its max-plus matrix."""
    ins, outs = cut_states(vocab, text, start), cut_states(vocab, text, end)
    matrix = np.full((len(ins), len(outs)), NEVER)
    units = inner_units(text, start, end)
    if units is None:
        reached = lattice(vocab, text, ins, end, outs if end < len(text) else None)
        for j, token in enumerate(outs):
            for bit in _arrivals(reached, token, end, len(text)):
                matrix[bit, j] = 0.0
    else:
        head = _head_bits(vocab, text, ins, units[0])
        reached = lattice(vocab, text, _at_unit(units[1]), end, outs if end < len(text) else None)
        for j, token in enumerate(outs):
            if _arrivals(reached, token, end, len(text)):
                matrix[sorted(head), j] = 0.0
    return [(a - start, z - start) for a, z in ins], [(a - end, z - end) for a, z in outs], matrix


def _head_bits(vocab, text, ins, place) -> set[int]:
    reached = lattice(vocab, text, ins, place)
    return {bit for token, back in reached.items() if token[1] == place for bit in back}


def _arrivals(reached: dict, token, end: int, size: int) -> set[int]:
    if end == size:  # the end of the document: any token that ends there
        return {bit for t, back in reached.items() if t[1] == end for bit in back}
    return set(reached.get(token, ()))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products by pairwise doubling (an associative scan)."""
    out, step = list(matrices), 1
    while step < len(out):
        out = [x if i < step else times(out[i - step], x) for i, x in enumerate(out)]
        step *= 2
    return out


def choose_states(matrices: list[np.ndarray]) -> list[int]:
    """The state at each cut (both ends of the document included) on the best path."""
    forward = scan(matrices)
    backward = [m.T for m in scan([m.T for m in matrices[::-1]])[::-1]]
    inner = [int(np.argmax(forward[i][0] + backward[i + 1][:, 0])) for i in range(len(matrices) - 1)]
    if forward[-1].max() == NEVER:
        raise ValueError("no path through the lattice")
    return [0, *inner, 0]


def backtrace(vocab: Vocabulary, text: str, start: int, end: int, state_in, state_out) -> list[int]:
    """Ids of the tokens that start within the chunk."""
    first, last = (start + state_in[0], start + state_in[1]), (end + state_out[0], end + state_out[1])
    done = end == len(text)
    units = inner_units(text, start, end)
    if units is None:
        reached = lattice(vocab, text, [first], end, None if done else [last])
        return _ids(vocab, text, _path(reached, last, end, done))
    head = []
    if first[1] < units[0]:
        reached = lattice(vocab, text, [first], units[0])
        head = _path(reached, None, units[0], True)
    middle = np.frombuffer(text[units[0] + 1:units[1]].replace(SPACE, " ").encode(), dtype=np.uint8) if units[1] > units[0] else None
    ids = _ids(vocab, text, head)
    if middle is not None:
        if len(middle):
            ids += vocab.encoder.ids(*_prefixed(middle))[0].tolist()
        else:
            ids += vocab.token_ids(SPACE)
    reached = lattice(vocab, text, _at_unit(units[1]), end, None if done else [last])
    return ids + _ids(vocab, text, _path(reached, last, end, done))


def _prefixed(data: np.ndarray):
    data = np.concatenate([[32], data]).astype(np.uint8)
    return data, np.array([0, len(data)])


def _path(reached, token, end, done):
    if done:
        token = next(t for t in reached if t[1] == end)
    return trace(reached, token, 0)


def _ids(vocab, text, tokens) -> list[int]:
    return [i for a, z in tokens for i in vocab.token_ids(text[a:z])]


# --- Spark jobs ------------------------------------------------------------------------------------------------


def _split(chunk: int, path: str):
    def run(batches):
        margin = vocabulary(path).longest
        for batch in batches:
            for i in range(batch.num_rows):
                parts = split_chunks(batch.column(2)[i].as_py(), chunk, margin)
                for at in range(0, len(parts), 64):
                    some = parts[at:at + 64]
                    yield pa.RecordBatch.from_pylist([{"k1": batch.column(0)[i].as_py(), "k2": batch.column(1)[i].as_py(),
                                                       "chunk": k, "text": t, "a": a, "z": z} for k, t, a, z in some],
                                                  _schema(("text", pa.string()), ("a", pa.int32()), ("z", pa.int32())))
    return run


def _matrices(path: str):
    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ins, outs, matrix = transfer(vocab, r["text"], r["a"], r["z"])
                rows.append({"k1": r["k1"], "k2": r["k2"], "chunk": r["chunk"], "ins": [x for s in ins for x in s],
                             "outs": [x for s in outs for x in s], "cells": (matrix == 0).astype(np.uint8).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, _schema(("ins", pa.list_(pa.int32())), ("outs", pa.list_(pa.int32())),
                                                           ("cells", pa.binary())))
    return run


def _schema(*more):
    return pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("chunk", pa.int32()), *more])


def _states(batches):
    """mapInArrow over (k1, k2, parts): the states at both ends of each chunk of a document."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            parts = sorted(r["parts"], key=lambda p: p["chunk"])
            matrices = [np.where(np.frombuffer(p["cells"], dtype=np.uint8).reshape(len(p["ins"]) // 2, -1) == 1, 0.0, NEVER)
                        for p in parts]
            chosen = choose_states(matrices)
            for p, i, o in zip(parts, chosen[:-1], chosen[1:]):
                rows.append({"k1": r["k1"], "k2": r["k2"], "chunk": p["chunk"],
                             "state": p["ins"][2 * i:2 * i + 2] + p["outs"][2 * o:2 * o + 2]})
        yield pa.RecordBatch.from_pylist(rows, _schema(("state", pa.list_(pa.int32()))))


def _backtraced(path: str):
    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                s = r["state"]
                ids = backtrace(vocab, r["text"], r["a"], r["z"], tuple(s[:2]), tuple(s[2:]))
                rows.append({"k1": r["k1"], "k2": r["k2"], "chunk": r["chunk"], "ids": ids})
            yield pa.RecordBatch.from_pylist(rows, _schema(("ids", pa.list_(pa.int32()))))
    return run


def encode_giants(texts: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """(k1, k2, ids) of distinct texts (k1, k2, text), by the scan over chunks."""
    keys = ["k1", "k2", "chunk"]
    chunks = stored(texts.select("k1", "k2", "text").mapInArrow(_split(chunk, path), "k1 long, k2 long, chunk int, text string, a int, z int")
                    .repartition(*keys), "sp-chunks")
    matrices = chunks.mapInArrow(_matrices(path), "k1 long, k2 long, chunk int, ins array<int>, outs array<int>, cells binary")
    states = (matrices.groupBy("k1", "k2").agg(F.collect_list(F.struct("chunk", "ins", "outs", "cells")).alias("parts"))
              .mapInArrow(_states, "k1 long, k2 long, chunk int, state array<int>"))
    traced = chunks.join(states, keys).select(*keys, "text", "a", "z", "state").mapInArrow(
        _backtraced(path), "k1 long, k2 long, chunk int, ids array<int>")
    parts = F.array_sort(F.collect_list(F.struct("chunk", "ids")))
    return traced.groupBy("k1", "k2").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def _is_giant(giant: int):
    return F.coalesce(F.length("text") > giant, F.lit(False))


def _with_giant_ids(docs: DataFrame, names: list[str], path: str, giant: int, chunk: int) -> DataFrame:
    """The giant documents of ``docs`` with their ids; equal texts are encoded once."""
    k1, k2 = text_key(F.col("text"))
    giants = docs.filter(_is_giant(giant)).select(*names, k1.alias("_k1"), k2.alias("_k2"))
    distinct = (docs.filter(_is_giant(giant)).select(k1.alias("k1"), k2.alias("k2"), "text").groupBy("k1", "k2")
                .agg(F.first("text").alias("text")))
    found = stored(encode_giants(distinct, path, chunk).toDF("_k1", "_k2", "ids"), "sp-giants")
    return giants.join(found, ["_k1", "_k2"]).select(*names, "ids")


def encode(docs: DataFrame, path: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """Every row of ``docs`` (column ``text``) with ``ids`` (array of int) added."""
    names = [c for c in docs.columns if c != "ids"]

    def small(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for at, data, off in slices(batch.column(0)):
                ids, counts = encode_slice(vocab, data, off)
                edge = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, len(counts)) for i in range(1, batch.num_columns)),
                                                  lists], names=[*batch.schema.names[1:], "ids"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)
    direct = (docs.filter(~_is_giant(giant)).select(F.col("text").alias("_t"), *names)
              .mapInArrow(small, f"{fields}, ids array<int>"))
    return direct.unionByName(_with_giant_ids(docs, names, path, giant, chunk))


DIGEST = "doc_id long, n_tokens long, ids_crc32 long, n_chars long, round_trip boolean"


def digest_rows(decoder: Decoder, doc_ids: pa.Array, texts: list[bytes], ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Counts, a checksum, and whether decoding gives the text back, from the ids of some documents."""
    ids = ids.astype("<u4")
    decoded = decoder.texts(ids, counts)
    cut = np.concatenate([[0], np.cumsum(counts)]).tolist()
    space = SPACE.encode()
    return pa.RecordBatch.from_arrays(
        [doc_ids, pa.array(np.asarray(counts, dtype=np.int64)),
         pa.array([zlib.crc32(ids[a:z]) for a, z in zip(cut[:-1], cut[1:])], pa.int64()),
         pa.array([len(d.decode()) for d in decoded], pa.int64()),
         pa.array([d == t.replace(space, b" ") for d, t in zip(decoded, texts)], pa.bool_())],
        names=["doc_id", "n_tokens", "ids_crc32", "n_chars", "round_trip"])


def _digest_small(path: str):
    """mapInArrow over (text, doc_id): documents encoded, decoded and digested slice by slice."""
    def run(batches):
        vocab = vocabulary(path)
        decoder = Decoder(vocab)
        for batch in batches:
            for at, data, off in slices(batch.column(0)):
                ids, counts = encode_slice(vocab, data, off)
                raw = data.tobytes()
                texts = [raw[a:z] for a, z in zip(off[:-1].tolist(), off[1:].tolist())]
                yield digest_rows(decoder, batch.column(1).slice(at, len(counts)), texts, ids, counts)
    return run


def _digest_ids(path: str):
    """mapInArrow over (text, doc_id, ids)."""
    def run(batches):
        decoder = Decoder(vocabulary(path))
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.asarray(batch.column(2)[i].values)
                yield digest_rows(decoder, batch.column(1).slice(i, 1), [(batch.column(0)[i].as_py() or "").encode()],
                                  ids, np.array([len(ids)]))
    return run


def digests(docs: DataFrame, path: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, n_chars and round_trip of every row of ``docs`` (doc_id, text)."""
    direct = docs.filter(~_is_giant(giant)).select("text", "doc_id").mapInArrow(_digest_small(path), DIGEST)
    giants = _with_giant_ids(docs, ["text", "doc_id"], path, giant, chunk)
    return direct.unionByName(giants.select("text", "doc_id", "ids").mapInArrow(_digest_ids(path), DIGEST))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (ids as little-endian unsigned 32-bit), n_chars of the decoded text and
    round_trip of every document."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
