"""H2 default: latent semantic vectors by a randomised singular value decomposition spread over the cluster.

The matrix has a row for each distinct text and a column for each word, with tf * idf weights and rows of length 1. It is a table of blocks
of texts (``BLOCK_WORDS`` words or one longer text), each a sparse matrix over its own words. A block of ``dims + EXTRA`` random signs
per word (from a hash, so reruns agree) is multiplied by the matrix and its transpose in turn, ``ROUNDS`` times. These vectors lie in files of
``FILE_WORDS`` words; a task reads those of the words of one block of texts, multiplies both ways and returns a row a word, summed over its
blocks. So what is shuffled in a round is a row for each word of a task, not for each word of each text, and it is summed
where the next files are written. After each product the vectors are made orthonormal by their Gram matrix, whose ``(dims + EXTRA) ** 2`` numbers,
summed by the tasks, and the paths of the files are all that reaches the driver. A text's vector is its row times the block,
turned to the principal axes.

Blank texts have zero vectors; null texts have none. With fewer independent words than dimensions the rest of a vector is zero.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraforge.functions import text as T
from paraforge.llm.token_files import place_of
from paraforge.operators.ranking import with_global_rank
from paraforge.session import release_shuffles, scratch_path, write_once

DIMS, EXTRA, ROUNDS = 32, 8, 4
BLOCK_WORDS, FILE_WORDS, HELD_WORDS = 1 << 19, 1 << 13, 1 << 17
AT_ONCE = 1 << 15  # weights that are multiplied at once


def _text_blocks(block_words: int):
    """mapInArrow over (text, words): blocks (block, texts, edge, place, tf, words, df). ``edge`` are the bounds of the texts in ``place`` (places
    in ``words``) and ``tf``; ``df`` counts the block's texts that have a word."""
    def run(batches):
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 33, [], 0

        def close():
            nonlocal number, held, size
            texts = pa.concat_arrays([b.column(0) for b in held])
            tokens = pa.concat_arrays([b.column(1).flatten() for b in held])
            counts = np.concatenate([np.diff(b.column(1).offsets.to_numpy()) for b in held])
            coded = tokens.dictionary_encode()
            words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            key, tf = np.unique(np.repeat(np.arange(len(counts)), counts) * max(1, len(words)) + codes, return_counts=True)
            row, place = np.divmod(key, max(1, len(words)))
            edge = np.searchsorted(row, np.arange(len(counts) + 1))
            out = pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts),
                 *[pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (edge, place, tf)],
                 pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                 pa.array([np.bincount(place, minlength=len(words)).tolist()], pa.list_(pa.int64()))],
                names=["block", "texts", "edge", "place", "tf", "words", "df"])
            number, held, size = number + 1, [], 0
            return out

        for batch in batches:
            offsets = batch.column(1).offsets.to_numpy().astype(np.int64)
            at = 0
            while at < batch.num_rows:
                # as many texts as fit in the block, one at least
                fit = int(np.searchsorted(offsets, offsets[at] + block_words - size, side="right")) - 1
                end = min(batch.num_rows, max(fit, at + (not held)))
                if end > at:
                    held.append(batch.slice(at, end - at))
                    size += int(offsets[end] - offsets[at])
                if end < batch.num_rows or size >= block_words:
                    yield close()
                at = end
        if held:
            yield close()
    return run


def _weighted(batches):
    """mapInArrow over (texts, edge, place, tf, numbers, idf): (texts, edge, place, weight, numbers) with rows of length 1."""
    for batch in batches:
        made = []
        for edge, place, tf, numbers, idf in zip(*(c.to_pylist() for c in batch.columns[1:])):
            at, where = np.frombuffer(edge, np.int32), np.frombuffer(place, np.int32)
            w = np.frombuffer(tf, np.int32) * np.array(idf or [], dtype=float)[where]
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))
            w /= np.sqrt(np.bincount(row, w * w, len(at) - 1))[row]
            made.append((w.tobytes(), np.array(numbers or [], dtype=np.int64).tobytes()))
        weight, numbers = (pa.array([m[i] for m in made], pa.binary()) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], weight, numbers], names=["texts", "edge", "place", "weight", "numbers"])


def term_matrix(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words (word, number from 0, idf) and the matrix over the distinct texts as blocks (texts, edge, place, weight, numbers)."""
    rows = texts.select("text").filter(F.col("text").isNotNull()).distinct()
    blocks = write_once(rows.select("text", T.word_tokens("text").alias("words")).mapInArrow(
        _text_blocks(BLOCK_WORDS), "block long, texts array<string>, edge binary, place binary, tf binary, words array<string>, df array<long>"),
        "embed-blocks")
    n = blocks.agg(F.sum(F.size("texts"))).first()[0] or 0
    found = blocks.select(F.inline(F.arrays_zip("words", "df"))).groupBy(F.col("words").alias("word")).agg(F.sum("df").alias("df"))
    found = found.select("word", (F.log(F.lit(1.0 + n) / (1.0 + F.col("df"))) + 1).alias("idf"))
    words = write_once(with_global_rank(found, ["word"], "number"), "embed-words")
    asked = blocks.select("block", F.posexplode("words").alias("at", "word")).join(words, "word")
    # One row a word of the block: at most a block's words.
    asked = asked.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "number", "idf"))).alias("all"))
    met = blocks.select("block", "texts", "edge", "place", "tf").join(asked, "block", "left")
    met = met.select("texts", "edge", "place", "tf", F.col("all.number").alias("numbers"), F.col("all.idf").alias("idf"))
    return words, write_once(met.mapInArrow(_weighted, "texts array<string>, edge binary, place binary, weight binary, numbers binary"), "embed-matrix")


def _columns(k: int) -> list[str]:
    return [f"v{i}" for i in range(k)]


def _in_files(rows: DataFrame, k: int, n: int) -> tuple[list[str], np.ndarray]:
    """The rows (number, v0 ..) of ``n`` words, summed by number, as files of ``FILE_WORDS`` rows of doubles in order of the numbers, and
    the k sums under the numbers -1, -2 .. (zeros if there are none). Rows are dealt by file, a task for each."""
    folder, per_file = scratch_path(rows.sparkSession, "embed-vectors"), FILE_WORDS
    parts = -(-n // per_file)

    def run(batches):
        system, base = place_of(folder)
        system.create_dir(base, recursive=True)
        part, held = None, None
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            if not len(numbers):
                continue
            if held is None:
                part = parts if numbers[0] < 0 else int(numbers[0]) // per_file
                held = np.zeros((k if part == parts else min(per_file, n - part * per_file), k))
            at = -1 - numbers if part == parts else numbers - part * per_file
            order = np.argsort(at, kind="stable")
            at, first = np.unique(at[order], return_index=True)
            held[at] += np.add.reduceat(np.stack([c.to_numpy()[order] for c in batch.columns[1:]], axis=1), first, axis=0)
        if held is not None:
            name = f"words-{part:08d}-{uuid.uuid4().hex}.bin"
            with system.open_output_stream(f"{base}/{name}", compression=None) as sink:
                sink.write(held.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([f"{folder}/{name}"])], names=["part", "file"])

    part = F.when(F.col("number") < 0, parts).otherwise(F.floor(F.col("number") / per_file)).cast("int")
    dealt = rows.repartitionById(parts + 1, part).select("number", *_columns(k)).mapInArrow(run, "part long, file string")
    made = {r["part"]: r["file"] for r in dealt.collect()}
    sums = made.pop(parts, None)
    return [made[i] for i in range(parts)], _read_rows(sums, k) if sums else np.zeros((k, k))


def _read_rows(file: str, k: int) -> np.ndarray:
    system, path = place_of(file)
    with system.open_input_file(path) as source:
        return np.frombuffer(source.read(), dtype=float).reshape(-1, k)


def _gram_of(spark, files: list[str], turn: np.ndarray) -> np.ndarray:
    """The Gram matrix of the rows in the files times a small matrix: k * k numbers to the driver."""
    k = len(turn)

    def run(batches):
        total = np.zeros((k, k))
        for batch in batches:
            for file in batch.column(0).to_pylist():
                x = _read_rows(file, k) @ turn
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], names=["at", "value"])

    if not files:
        return np.zeros((k, k))
    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(min(len(files), 256))
    out = np.zeros(k * k)
    for row in listed.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[row["at"]] = row["value"]
    return out.reshape(k, k)


def _orthonormal(gram: np.ndarray) -> np.ndarray:
    """What turns a block with this Gram matrix into an orthonormal one; directions without length become zero."""
    values, axes = np.linalg.eigh(gram)
    some = values > max(values[-1], 0) * 1e-12
    return axes * np.where(some, 1 / np.sqrt(np.where(some, values, 1)), 0)


def _rows_of(numbers: np.ndarray, files: list[str], turn: np.ndarray, per_file: int) -> np.ndarray:
    """The rows of the words with these numbers times ``turn``; a file is held at a time."""
    out, part = np.zeros((len(numbers), len(turn))), numbers // per_file
    for p in np.unique(part).tolist():
        here = part == p
        out[here] = _read_rows(files[p], len(turn))[numbers[here] - p * per_file]
    return out @ turn


def _sums(edge: np.ndarray, weight: np.ndarray, index: np.ndarray, source: np.ndarray) -> np.ndarray:
    """For each segment of ``edge`` the sum of weight times the row ``index`` of ``source``, ``AT_ONCE`` at a time."""
    out = np.zeros((len(edge) - 1, source.shape[1]))
    some = np.flatnonzero(np.diff(edge))
    bounds = np.append(edge[some], edge[-1])
    for a in range(0, len(weight), AT_ONCE):
        z = min(a + AT_ONCE, len(weight))
        first, last = int(np.searchsorted(bounds, a, side="right")) - 1, int(np.searchsorted(bounds, z, side="left"))
        product = weight[a:z, None] * source[index[a:z]]
        out[some[first:last]] += np.add.reduceat(product, np.maximum(bounds[first:last], a) - a, axis=0)
    return out


def _texts_times(edge: bytes, place: bytes, weight: bytes, numbers: bytes, files: list[str], turn: np.ndarray, per_file: int):
    """A block's arrays and its texts' rows times the vectors (the rows of the files times ``turn``)."""
    edge, place = np.frombuffer(edge, np.int32).astype(np.int64), np.frombuffer(place, np.int32)
    weight, numbers = np.frombuffer(weight, float), np.frombuffer(numbers, np.int64)
    return edge, place, weight, numbers, _sums(edge, weight, place, _rows_of(numbers, files, turn, per_file))


def _merged(numbers: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The rows summed by number."""
    at = np.concatenate(numbers)
    order = np.argsort(at, kind="stable")
    at, first = np.unique(at[order], return_index=True)
    return at, np.add.reduceat(np.concatenate(values)[order], first, axis=0)


def _there_and_back(matrix: DataFrame, files: list[str], turn: np.ndarray, back: bool = True) -> DataFrame:
    """(number, v0 ..): the transposed matrix times the matrix times the vectors, to be summed by word, and under the numbers -1, -2 .. the
    rows of the Gram matrix of the matrix times the vectors; without ``back`` these only. A task sums the words of its blocks as long as they
    are not more than ``HELD_WORDS``."""
    k, per_file, most = len(turn), FILE_WORDS, HELD_WORDS

    def run(batches):
        total, held, values = np.zeros((k, k)), [], []

        def rows(numbers, x):
            for i in range(0, len(numbers), 1 << 13):
                some = x[i:i + (1 << 13)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[i:i + (1 << 13)]), *[pa.array(np.ascontiguousarray(some[:, j])) for j in range(k)]], names=["number", *_columns(k)])

        for batch in batches:
            for packed in zip(*batch.columns):
                edge, place, weight, numbers, there = _texts_times(*(x.as_py() for x in packed), files, turn, per_file)
                total += there.T @ there
                if not back or not len(numbers):
                    continue
                order = np.argsort(place, kind="stable")
                text = np.repeat(np.arange(len(edge) - 1), np.diff(edge))[order]
                held.append(numbers)
                values.append(_sums(np.searchsorted(place[order], np.arange(len(numbers) + 1)), weight[order], text, there))
                if sum(map(len, held)) > most:
                    numbers, x = _merged(held, values)
                    held, values = [numbers], [x]
                    if len(numbers) > most // 2:
                        yield from rows(numbers, x)
                        held, values = [], []
        if held:
            yield from rows(*_merged(held, values))
        yield from rows(-1 - np.arange(k), total)

    blocks = matrix.select("edge", "place", "weight", "numbers")
    return blocks.mapInArrow(run, ", ".join(["number long", *[f"{c} double" for c in _columns(k)]]))


def _drop(files: list[str]) -> None:
    """Remove files that no later step reads."""
    for file in files:
        system, path = place_of(file)
        system.delete_file(path)


def principal_words(words: DataFrame, matrix: DataFrame, k: int, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """The files of a block, and what turns it into an orthonormal one that spans the matrix's leading word directions."""
    n = words.count()
    files, _ = _in_files(words.select("number", *[
        F.when(F.xxhash64(F.lit(i), "word").bitwiseAND(F.lit(1)) == 0, 1.0).otherwise(-1.0).alias(c) for i, c in enumerate(_columns(k))]), k, n)
    turn = np.eye(k)
    for _ in range(rounds):
        back, gram = _in_files(_there_and_back(matrix, files, turn), k, n)
        _drop(files)
        release_shuffles(matrix.sparkSession)
        # The texts' rows would be turned before they go back: the sums by word are turned instead.
        files, turn = back, _orthonormal(gram)
        turn = turn @ _orthonormal(_gram_of(matrix.sparkSession, files, turn))
    return files, turn


def latent_vectors(texts: DataFrame, dims: int = DIMS, rounds: int = ROUNDS) -> DataFrame:
    """H2: (text, vec array<float>) of each distinct text."""
    words, matrix = term_matrix(texts)
    k, per_file = dims + EXTRA, FILE_WORDS
    files, turn = principal_words(words, matrix, k, rounds)
    _, gram = _in_files(_there_and_back(matrix, files, turn, back=False), k, 0)
    axes = np.linalg.eigh(gram)[1][:, ::-1][:, :dims]  # leading directions first

    def run(batches):
        for batch in batches:
            for texts_of, *packed in zip(*batch.columns):
                vectors = (_texts_times(*(x.as_py() for x in packed), files, turn, per_file)[-1] @ axes).astype(np.float32)
                for i in range(0, len(vectors), 1 << 13):
                    some = vectors[i:i + (1 << 13)]
                    offsets = pa.array(np.arange(len(some) + 1) * dims, pa.int32())
                    yield pa.RecordBatch.from_arrays([texts_of.values.slice(i, 1 << 13), pa.ListArray.from_arrays(offsets, pa.array(some.ravel()))],
                                                     names=["text", "vec"])

    return matrix.select("texts", "edge", "place", "weight", "numbers").mapInArrow(run, "text string, vec array<float>")
