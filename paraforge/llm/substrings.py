"""Exact removal of word passages that repeat, by level-wise doubling of window lengths.

A passage is repeated if a window of ``window`` consecutive words of one document also starts
anywhere else, in the same document or another. Windows of that length are not compared at once:

1. Level 1 looks at windows of about a quarter of the length. Of those inside each full window only
   the one with the least hash stands for it, so about 2 in 28 places are compared; equal full
   windows choose equal representatives, so none is missed. Hashes that occur once end here.
2. Places that survive give *runs*: maximal stretches of full windows that may repeat. Equal runs
   are counted and merged (copies of texts and shared passages become one row with a count).
3. Level 2 does the same with twice the length, on merged runs only.
4. The last level compares the survivors' full windows by a 128-bit hash.

Counting is a partial aggregate per hash, and places meet the repeated hashes in an equi-join, so a
passage that a third of all documents share is one hot join key, which adaptive execution splits;
no group of places is ever collected. Texts are identified by a 128-bit hash (``text_key``), so null
or repeated ids, repeated rows and other columns do not matter: rows with equal texts of at least
``window`` words repeat each other and lose all their words. Null, empty and shorter texts keep all
their words. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraforge.llm.common import stored, table, text_key, unused
from paraforge.llm.words import U64, as_signed, row_of, slices, sliding_argmin, window_hashes, word_hashes, word_spans

WINDOW = 35
LAST = U64(2**64 - 1)


def level_lengths(window: int) -> list[int]:
    """The lengths before the last: a quarter and a half of it, rounded up (9 and 18 for 35)."""
    half = -(-window // 2)
    return [max(1, -(-half // 2)), max(1, half)]


def representatives(words: np.ndarray, ends: np.ndarray, length: int, window: int):
    """For each place: whether a full window starts there, the place of the short window that stands
    for it, and the hashes of the short windows. ``ends`` is the end of each word's row."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, U64)
    short = window_hashes(words, length)
    whole = np.arange(len(short)) + length <= ends[:len(short)]
    least = sliding_argmin(np.where(whole, short, LAST), window - length + 1)[:n]
    return np.arange(n) + window <= ends[:n], least, short


def read_words(data, off):
    starts, ends, first = word_spans(data, off)
    return word_hashes(data, starts, ends), first


def read_runs(data, off):
    return data.copy().view(U64), off // 8


def _anchors(keys: list[str], reader, length: int, window: int):
    """mapInArrow over (key columns, binary or text): one (h, keys, pos) per representative."""
    def emit(batches):
        for batch in batches:
            own = [np.asarray(batch.column(i)) for i in range(len(keys))]
            for at, data, off in slices(batch.column(len(keys))):
                words, first = reader(data, off)
                row = row_of(first, len(words))
                ok, least, short = representatives(words, first[1:][row], length, window)
                place = np.unique(least[ok])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_signed(short[place])), *[pa.array(k[at + row[place]]) for k in own],
                     pa.array((place - first[row[place]]).astype(np.int32))], names=["h", *keys, "pos"])
    return emit


def _many(places: DataFrame, hashes: list[str]) -> DataFrame:
    """The hashes that occur twice or more; written, so that a join with them reads plain exchanges
    on both sides, whose hot keys adaptive execution can split."""
    return stored(places.groupBy(*hashes).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*hashes),
                  "substr-many")


def _repeated(places: DataFrame, keys: list[str], hashes: list[str]) -> DataFrame:
    """The places whose hash occurs at two or more places."""
    return places.join(_many(places, hashes), hashes).select(*keys, "pos")


def _alive_lists(places: DataFrame, keys: list[str]) -> DataFrame:
    """The surviving places of each text or run in one row (no more than it has words)."""
    return places.groupBy(*keys).agg(F.collect_set("pos").alias("alive"))


def _alive_starts(words, first, alive, at, length, window):
    """Full windows whose representative survived; ``alive`` holds the places of each row."""
    row = row_of(first, len(words))
    ok, least, _ = representatives(words, first[1:][row], length, window)
    lists = alive.slice(at, len(first) - 1)
    sizes = np.diff(np.asarray(lists.offsets, dtype=np.int64))
    mark = np.zeros(len(words) + 1, dtype=bool)
    mark[np.repeat(first[:-1], sizes) + np.asarray(lists.flatten(), dtype=np.int64)] = True
    return row, ok & mark[least]


def _runs(length: int, window: int):
    """mapInArrow over (text, k1, k2, alive, copies): one row per run with its 128-bit hash and words."""
    def emit(batches):
        for batch in batches:
            k1, k2, copies = (np.asarray(batch.column(i)) for i in (1, 2, 4))
            for at, data, off in slices(batch.column(0)):
                words, first = read_words(data, off)
                row, live = _alive_starts(words, first, batch.column(3), at, length, window)
                new_row = np.diff(row[:len(live)]) != 0
                begin, stop = live.copy(), live.copy()
                begin[1:] &= ~live[:-1] | new_row
                stop[:-1] &= ~live[1:] | new_row
                begin, stop = np.flatnonzero(begin), np.flatnonzero(stop) + window
                if len(begin) == 0:
                    continue
                sizes = stop - begin
                upto = np.cumsum(sizes)
                packed = words[np.repeat(begin - (upto - sizes), sizes) + np.arange(upto[-1])]
                both = [_range_hash(words, begin, stop, seed) for seed in (3, 4)]
                owner = at + row[begin]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[owner]), pa.array(k2[owner]), pa.array(copies[owner]), pa.array((begin - first[row[begin]]).astype(np.int32)),
                     pa.array(sizes.astype(np.int32)), pa.array(both[0]), pa.array(both[1]),
                     pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [
                         None, pa.py_buffer(np.concatenate([[0], upto * 8]).astype(np.int64)),
                         pa.py_buffer(packed)]).cast(pa.binary())],
                    names=["k1", "k2", "copies", "a", "n", "r1", "r2", "words"])
    return emit


def _range_hash(words, begin, stop, seed):
    from paraforge.llm.words import mix, powers

    up, down = powers(seed + 101, len(words))
    sums = np.zeros(len(words) + 1, dtype=U64)
    np.cumsum(words * up[:len(words)], out=sums[1:])
    return as_signed(mix(((sums[stop] - sums[begin]) * down[begin]) ^ (stop - begin).astype(U64)))


def _full_windows(length: int, window: int):
    """mapInArrow over (words, run, single, alive): a 128-bit hash per surviving full window."""
    def emit(batches):
        for batch in batches:
            run, single = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in (1, 2))
            for at, data, off in slices(batch.column(0)):
                words, first = read_runs(data, off)
                row, live = _alive_starts(words, first, batch.column(3), at, length, window)
                place = np.flatnonzero(live)
                owner = at + row[place]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_signed(window_hashes(words, window, seed)[place])) for seed in (5, 6)]
                    + [pa.array(run[owner]), pa.array(single[owner]), pa.array((place - first[row[place]]).astype(np.int32))],
                    names=["h1", "h2", "run", "single", "pos"])
    return emit


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(k1, k2, spans) for each text of ``docs`` (column ``text``) with repeated windows; a span is a
    struct (a, b) of words a to b - 1; spans of a text may touch or overlap."""
    short, half = level_lengths(window)
    texts = docs.select(*text_key(F.col("text")), "text")

    first = texts.mapInArrow(_anchors(["k1", "k2"], read_words, short, window), "h long, k1 long, k2 long, pos int")
    alive = _alive_lists(_repeated(first, ["k1", "k2"], ["h"]), ["k1", "k2"])
    # texts are merged in the exchange of the join: a text that many rows repeat is one row from here on
    distinct = texts.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    runs = stored(distinct.join(alive, ["k1", "k2"]).select("text", "k1", "k2", "alive", "copies").mapInArrow(
        _runs(short, window), "k1 long, k2 long, copies long, a int, n int, r1 long, r2 long, words binary"), "substr-runs")

    # the number is fixed by the written table, and short beside the run's hash in the exchanges below
    merged = stored(runs.groupBy("r1", "r2").agg(F.sum("copies").alias("times"), F.first("n").alias("n"),
                                                 F.first("words").alias("words"))
                    .withColumn("run", F.monotonically_increasing_id()), "substr-merged")
    second = merged.select("run", "words").mapInArrow(_anchors(["run"], read_runs, half, window), "h long, run long, pos int")
    alive = _alive_lists(_repeated(second, ["run"], ["h"]), ["run"])
    full = merged.join(alive, "run").select("words", "run", (F.col("times") == 1).alias("single"), "alive").mapInArrow(
        _full_windows(half, window), "h1 long, h2 long, run long, single boolean, pos int")
    hits = full.filter("single").select("h1", "h2", "run", "pos").join(_many(full, ["h1", "h2"]), ["h1", "h2"])
    spans = (hits.groupBy("run").agg(F.array_sort(F.collect_set("pos")).alias("p"))
             .select("run", F.transform("p", lambda x: F.struct(x.alias("a"), (x + window).alias("b"))).alias("spans")))
    spans = spans.select("run", _merge(F.col("spans")).alias("spans"))
    whole = merged.filter("times > 1").select(
        "run", F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).alias("spans"))
    of_run = merged.select("r1", "r2", "run").join(spans.unionByName(whole), "run").select("r1", "r2", "spans")
    placed = runs.select("k1", "k2", "a", "r1", "r2").join(of_run, ["r1", "r2"])
    shifted = placed.select("k1", "k2", F.transform("spans", lambda s: F.struct(
        (s["a"] + F.col("a")).alias("a"), (s["b"] + F.col("a")).alias("b"))).alias("spans"))
    return stored(shifted.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans")), "substr-spans")


def _merge(spans):
    """Join sorted, touching or overlapping spans of one run."""
    start = F.slice(spans, 1, 1)
    step = lambda acc, s: F.when(
        s["a"] <= F.element_at(acc, -1)["b"],
        F.concat(F.slice(acc, 1, F.size(acc) - 1),
                 F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), s["b"].alias("b"))))
    ).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(F.slice(spans, 2, F.greatest(F.size(spans), F.lit(1))), start, step)


def _strip(batches):
    """mapInArrow over (text, spans, ...): the kept words joined by one space, and both counts."""
    for batch in batches:
        rest = [batch.column(i) for i in range(2, batch.num_columns)]
        names = batch.schema.names[2:]
        lists = batch.column(1)
        for at, data, off in slices(batch.column(0)):
            starts, ends, first = word_spans(data, off)
            rows = len(off) - 1
            some = lists.slice(at, rows)
            sizes = np.diff(np.asarray(some.offsets, dtype=np.int64))
            flat = some.flatten()
            gone = np.zeros(len(starts) + 1, dtype=np.int64)
            base = np.repeat(first[:-1], sizes)
            if len(flat):
                begin, end = flat.flatten()  # unlike field(), this minds the slice
                np.add.at(gone, base + np.asarray(begin, dtype=np.int64), 1)
                np.add.at(gone, base + np.asarray(end, dtype=np.int64), -1)
            keep = np.cumsum(gone)[:-1] == 0
            upto = np.concatenate([[0], np.cumsum(keep)])[first]
            raw = data.tobytes()
            a, b = starts[keep].tolist(), ends[keep].tolist()
            texts = [b" ".join([raw[x:y] for x, y in zip(a[p:q], b[p:q])]).decode() for p, q in zip(upto[:-1].tolist(), upto[1:].tolist())]
            n_words = np.diff(first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()), pa.array(n_words), pa.array(n_words - np.diff(upto)),
                 *[c.slice(at, rows) for c in rest]], names=["kept_text", "n_words", "n_removed", *names])


def strip_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row of ``docs`` with ``kept_text`` (words not covered by a repeated window, joined by one
    space), ``n_words`` and ``n_removed`` added. The operator's columns win over input columns of the
    same names, apart from ``text``."""
    own = ["kept_text", "n_words", "n_removed"]
    names = [c for c in docs.columns if c not in own]
    a, b, found, text = unused(docs, "k1", "k2", "spans", "whole")
    spans = repeated_spans(docs, window).toDF(a, b, found)
    k1, k2 = text_key(F.col("text"))
    keyed = docs.select(*names, k1.alias(a), k2.alias(b)).join(spans, [a, b], "left")
    empty = F.array().cast("array<struct<a:int,b:int>>")
    rows = keyed.select(F.col("text").alias(text), F.coalesce(found, empty).alias(found), *names)
    schema = "kept_text string, n_words long, n_removed long, " + ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)
    return rows.mapInArrow(_strip, schema).select(*names, *own)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document, windows of 35 words."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return _digest(strip_repeats(docs))


def _digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
