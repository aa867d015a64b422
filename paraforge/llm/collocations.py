"""Phrase collocation mining over sorted count streams, merged in lockstep.

1. *Runs.* Texts are lower-cased, cut at marks and line breaks into pieces and at spaces into words. Every word begins the longest phrase of
   up to ``max_words`` words that its piece allows. A task sorts the phrases of about ``RUN_WORDS`` words at a time and sums
   equal ones: a run in *prefix order* (language, first word, second word ...). All shorter phrases are prefixes of
   these, so a run of the longest order holds the counts of every order.
2. *Merge.* Runs are dealt to ranges of (language, first two words), sorted, and read once in order: rows that share
   their first m words lie together, so each order's counts are sums between two changes, and phrases below ``min_count`` end there.
   The bounds of the ranges come from a sample of ``SAMPLE_DOCS`` documents; they affect the balance only.
3. *Prefix order.* The frequent phrases, in ranges of the same order, are read in lockstep with their own prefixes: the row of a phrase comes
   right before the rows that extend it. A pass keeps one open row per order, which gives every phrase the counts of its
   first words and each open row the greatest count of a phrase that extends it to the right.
4. *Suffix order.* The same pass over the phrases with their words reversed gives the counts of the last words and of
   extensions to the left.
5. Cuts are scored in decimal arithmetic (38 digits), absorbed phrases go, and the best of each language are ranked, first
   inside 64 parts of a language, then among the parts' best.

Nothing is looked up in a hash table across tasks and no stream is collected. A first word's count may lie in an earlier range than
its extensions: the last first word of each range (a row a range) is handed on by a broadcast join.

Null texts are empty; null languages are ``und``. Repeated rows count again. Columns beside lang and text are ignored. An
empty table gives an empty result. Ties in score and count go by the phrase's bytes. Words may hold any character but
the separators: U+0000 and U+0001, which the streams use, are escaped and restored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paraforge.llm.common import stored, table
from paraforge.llm.words import lower_ascii, slices

# Fixed values of the contract.
MARKS = b".,;:!?\n\x0b\x0c\r"
SPACES = b" \t"
MAX_WORDS, MIN_COUNT, ABSORBED, TOP = 3, 10, 50, 2000

RUN_WORDS = 1 << 21
SAMPLE_DOCS, SAMPLE_KEYS = 2000, 32
PARTS = 64
STREAM = "key string, n long"
OPEN = "key string, n long, ext long, part int, before array<long>, carried array<long>"


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


NOTHING = pa.scalar("", pa.large_string())
MARK, SPACE = _table(MARKS), _table(SPACES)


def _end(column: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(column, NOTHING, pa.scalar("\0", pa.large_string()))


class _Words:
    """The words of many texts: their bytes, lengths, pieces and languages."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.data, self.lengths, self.pieces, self.langs, self.n, self.last = [], [], [], [], 0, 0

    def add(self, data: np.ndarray, off: np.ndarray, langs: np.ndarray) -> None:
        data = lower_ascii(data)
        mark = MARK[data]
        solid = ~(mark | SPACE[data])
        inner = np.zeros(len(data) + 1, dtype=bool)
        inner[:-1] = solid
        before = np.zeros(len(data) + 1, dtype=bool)
        before[1:] = solid
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[off] = True
        starts = np.flatnonzero(inner & (~before | edge))
        ends = np.flatnonzero(before & (~inner | edge))
        row = np.searchsorted(off, starts, side="right") - 1
        piece = np.cumsum(mark)[starts] + row if len(data) else starts
        self.data.append(data[solid])
        self.lengths.append(ends - starts)
        self.pieces.append(piece + self.last)
        self.langs.append(langs[row])
        self.last += int(mark.sum()) + len(off)
        self.n += len(starts)

    def run(self, names: list[str], max_words: int) -> tuple[pa.Array, np.ndarray]:
        """The sorted distinct longest phrases as keys (language, then words, each ended by U+0000) and their counts."""
        by_name = sorted(range(len(names)), key=lambda i: names[i].encode())
        lang_rank = np.empty(len(names), dtype=np.int64)
        lang_rank[by_name] = np.arange(len(names))
        lengths = np.concatenate(self.lengths)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        data = np.concatenate(self.data)
        words = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(data))
        coded = words.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        vocabulary = coded.dictionary.take(pa.array(order))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        code = rank[coded.indices.to_numpy()]
        piece, lang = np.concatenate(self.pieces), lang_rank[np.concatenate(self.langs)]
        # Code 0 stands for "no word": phrases that end with their piece come before their extensions.
        base = len(order) + 1
        ids, levels = lang, []
        for m in range(max_words):
            word = np.zeros(len(code), dtype=np.int64)
            end = max(0, len(code) - m)
            inside = piece[m:] == piece[:end] if m else np.ones(end, dtype=bool)
            word[:end] = np.where(inside, code[m:] + 1, 0)
            level, ids, counts = np.unique(ids * base + word, return_inverse=True, return_counts=True)
            levels.append(level)
        parent, columns = np.arange(len(levels[-1])), []
        for level in reversed(levels):
            at = level[parent]
            columns.append(at % base)
            parent = at // base
        key = _end(pa.array([names[i] for i in by_name], pa.large_string())).take(pa.array(parent))
        shown = pa.concat_arrays([pa.array([""], pa.large_string()), _end(vocabulary)])
        for column in reversed(columns):
            key = pc.binary_join_element_wise(key, shown.take(pa.array(column)), NOTHING)
        return key, counts


def _escape(column: pa.Array) -> pa.Array:
    """U+0000 and U+0001 are told apart from the streams' own marks."""
    column = pc.replace_substring(column, "\x01", "\x01\x02")
    return pc.replace_substring(column, "\0", "\x01\x01")


def _counted(max_words: int, run_words: int, bounds: list[str]):
    """mapInArrow over (lang, text): (part, key, n) of each run, in prefix order."""
    edges = [b.encode() for b in bounds]

    def emit(words: _Words, names: list[str]):
        if not words.n:
            return
        key, counts = words.run(names, max_words)
        places = [_bisect(key, e) for e in edges]
        part = np.searchsorted(np.array(places, dtype=np.int64), np.arange(len(key)), side="right").astype(np.int32)
        for at in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[at:at + (1 << 16)]), key.slice(at, 1 << 16).cast(pa.string()),
                 pa.array(counts[at:at + (1 << 16)].astype(np.int64))], names=["part", "key", "n"])

    def run(batches):
        words, names, codes = _Words(), [], {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for at, data, off in slices(_escape(batch.column(1).fill_null(""))):
                rows = []
                for name in langs[at:at + len(off) - 1]:
                    rows.append(codes.setdefault(name, len(codes)))
                words.add(data, off, np.array(rows, dtype=np.int64))
                if words.n >= run_words:
                    yield from emit(words, list(codes))
                    words.clear()
        yield from emit(words, list(codes))
    return run


def _bisect(keys: pa.Array, edge: bytes) -> int:
    """The first position whose key is not below the edge."""
    low, high = 0, len(keys)
    while low < high:
        mid = (low + high) // 2
        if keys[mid].as_py().encode() < edge:
            low = mid + 1
        else:
            high = mid
    return low


def _range_bounds(texts: DataFrame, parts: int, max_words: int) -> list[str]:
    """Up to ``parts`` - 1 bounds of (language, first two words) from a bounded sample of documents."""
    n = texts.count()
    some = texts if n <= SAMPLE_DOCS else texts.sample(fraction=SAMPLE_DOCS / n, seed=1)
    counted = _counted(max_words, 1, [])

    def sample(batches):
        rng = np.random.default_rng(1)
        for batch in batches:
            for i in range(batch.num_rows):
                found = pa.Table.from_batches(list(counted([batch.slice(i, 1)])),
                                              pa.schema([("part", pa.int32()), ("key", pa.string()), ("n", pa.int64())]))
                pick = rng.permutation(found.num_rows)[:SAMPLE_KEYS]
                yield pa.RecordBatch.from_arrays([found.column("key").take(pa.array(pick)).combine_chunks()], names=["key"])

    keys = [r[0] for r in some.mapInArrow(sample, "key string").collect()]
    heads = sorted({"\0".join(k.split("\0")[:3]) for k in keys}, key=str.encode) if len(keys) < parts else \
        sorted(("\0".join(k.split("\0")[:3]) for k in keys), key=str.encode)
    return sorted({heads[i * len(heads) // parts] for i in range(1, parts)}, key=str.encode) if heads else []


def _common(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Length of the prefix that each key shares with the key before it (0 for the first)."""
    n = len(off) - 1
    size = np.diff(off)
    out = np.zeros(n, dtype=np.int64)
    if n < 2:
        return out
    reach = np.minimum(size[1:], size[:-1])
    starts = np.concatenate([[0], np.cumsum(reach)])
    inside = np.arange(starts[-1]) - np.repeat(starts[:-1], reach)
    same = data[np.repeat(off[1:-1], reach) + inside] == data[np.repeat(off[:-2], reach) + inside]
    differ = np.flatnonzero(~same)
    first = np.searchsorted(differ, starts[:-1])
    at = differ[np.minimum(first, len(differ) - 1)] if len(differ) else np.zeros(n - 1, dtype=np.int64)
    hit = (first < len(differ)) & (at < starts[1:])
    out[1:] = np.where(hit, at - starts[:-1], reach)
    return out


def _merged(max_words: int, min_count: int):
    """mapInArrow over sorted (key, n): the counts of all orders; one word phrases whole or in part, others from ``min_count`` on."""
    def rows(found: list):
        return pa.RecordBatch.from_arrays([pa.array([k.decode() for k, _ in found], pa.string()),
                                           pa.array([c for _, c in found], pa.int64())], names=["key", "n"])

    def run(batches):
        last, open_sums = b"", [0] * max_words
        for batch in batches:
            if batch.num_rows == 0:
                continue
            column = batch.column(0)
            data, off = next((d, o) for _, d, o in slices(column, 1 << 62))
            data = np.concatenate([np.frombuffer(last, dtype=np.uint8), data])
            off = np.concatenate([[0], off + len(last)])
            shared = _common(data, off)
            ends = np.flatnonzero(data == 0) + 1
            first = np.searchsorted(ends, off[:-1], side="right")
            orders = np.searchsorted(ends, off[1:], side="right") - first - 1
            n = np.concatenate([[0], batch.column(1).to_numpy()])
            found = []
            for m in range(1, max_words + 1):
                has = orders >= m
                stop = ends[np.minimum(first + m, len(ends) - 1)]
                counts = np.where(has, n, 0)
                counts[0] = open_sums[m - 1]
                starts = np.flatnonzero(has & (shared < stop - off[:-1]))
                if len(starts) == 0:
                    open_sums[m - 1] = 0
                    continue
                sums = np.add.reduceat(counts, starts)
                # The last group stays open if the last key begins with its phrase.
                held = len(starts) - 1 if has[-1] else len(starts)
                open_sums[m - 1] = int(sums[-1]) if has[-1] else 0
                least = min_count if m > 1 else 1
                for g in np.flatnonzero(sums[:held] >= least).tolist():
                    s = starts[g]
                    found.append((data[off[s]:stop[s]].tobytes(), int(sums[g])))
            last = data[off[-2]:off[-1]].tobytes()
            if found:
                yield rows(found)
        parts = last.split(b"\0")[:-1]
        yield rows([(b"\0".join(parts[:m + 1]) + b"\0", open_sums[m - 1]) for m in range(1, len(parts))
                    if open_sums[m - 1] >= (min_count if m > 1 else 1)])
    return run


def _lockstep(batches):
    """mapInArrow over sorted (key, n, carried): each phrase with the counts of its proper prefixes (null where the row lies
    in an earlier range) and the greatest count of a phrase that extends it by one word."""
    from pyspark import TaskContext

    part, open_rows, done = TaskContext.get().partitionId(), [], []

    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], pa.int64()), pa.array([part] * len(rows), pa.int32()),
             pa.array([r[3] for r in rows], pa.list_(pa.int64())), pa.array([r[5] for r in rows], pa.list_(pa.int64()))],
            names=["key", "n", "ext", "part", "before", "carried"])

    for batch in batches:
        for key, n, carried in zip(*(batch.column(i).to_pylist() for i in range(3))):
            while open_rows and not key.startswith(open_rows[-1][0]):
                done.append(open_rows.pop())
            known = {r[4]: r for r in open_rows}
            order = key.count("\0") - 1
            if order - 1 in known:
                above = known[order - 1]
                above[2] = max(above[2], n)
            open_rows.append([key, n, 0, [known[m][1] if m in known else None for m in range(1, order)], order, carried])
        if len(done) > 50_000:
            yield batch_of(done)
            done = []
    yield batch_of(done + open_rows)


def _with_contexts(stream: DataFrame, name: str) -> DataFrame:
    """(key, n, ext, before, carried) of all phrases of a stream (key, n, carried), read in the order of its keys."""
    ordered = (stream.select("key", "n", "carried").repartitionByRange(F.substring_index("key", "\0", 3))
               .sortWithinPartitions("key"))
    rows = stored(ordered.mapInArrow(_lockstep, OPEN), name)
    single = F.length("key") - F.length(F.replace("key", F.lit("\0"), F.lit(""))) == 2
    handed = (rows.filter(single).groupBy("part").agg(F.max(F.struct("key", "n")).alias("x"))
              .select(F.col("x.key").alias("head"), F.col("x.n").alias("head_n")))
    # One row per range at most, so this side is bounded by the number of partitions.
    head = F.concat(F.substring_index("key", "\0", 2), F.lit("\0"))
    rows = rows.withColumn("head", F.when(F.get("before", F.lit(0)).isNull() & (F.size("before") > 0), head))
    fixed = F.concat(F.array("head_n"), F.slice("before", 2, F.greatest(F.size("before") - 1, F.lit(0))))
    return (rows.join(F.broadcast(handed.groupBy("head").agg(F.max("head_n").alias("head_n"))), "head", "left")
            .select("key", "n", "ext", "carried", F.when(F.col("head").isNull(), F.col("before")).otherwise(fixed).alias("before")))


def phrase_counts(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(key, n) of the frequent phrases of every order, and (lang, n) of all words; docs has lang and text."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter("length(text) > 0")
    texts = texts.withColumn("lang", F.replace(F.replace("lang", F.lit("\x01"), F.lit("\x01\x02")), F.lit("\0"), F.lit("\x01\x01")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _range_bounds(texts, parts, max_words)
    runs = texts.mapInArrow(_counted(max_words, RUN_WORDS, bounds), "part int, " + STREAM)
    ordered = runs.repartitionById(parts, "part").select("key", "n").sortWithinPartitions("key")
    merged = stored(ordered.mapInArrow(_merged(max_words, min_count), STREAM), "phrase-counts")
    single = F.length("key") - F.length(F.replace("key", F.lit("\0"), F.lit(""))) == 2
    ones = merged.filter(single)
    totals = ones.groupBy(F.substring_index("key", "\0", 1).alias("lang")).agg(F.sum("n").alias("n"))
    frequent = ones.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    return frequent.unionByName(merged.filter(~single)), totals


def _plain(text):
    return F.replace(F.replace(text, F.lit("\x01\x01"), F.lit("\0")), F.lit("\x01\x02"), F.lit("\x01"))


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, absorbed: int = ABSORBED,
                 top: int | None = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of each language (all of them if ``top`` is None)."""
    stream, totals = phrase_counts(docs, max_words, min_count)
    first = _with_contexts(stream.withColumn("carried", F.array().cast("array<long>")), "phrase-prefixes")
    words = F.split("key", "\0")
    size = F.size(words) - 2
    back = F.concat(F.element_at(words, 1), F.lit("\0"),
                    F.concat_ws("\0", F.reverse(F.slice(words, F.lit(2), size))), F.lit("\0"))
    # The counts of the first words and of the extensions to the right travel with the phrase to the suffix order.
    turned = first.select(back.alias("key"), "n", F.concat(F.array("ext"), "before").alias("carried"))
    both = _with_contexts(turned, "phrase-suffixes").select(
        "key", "n", F.col("ext").alias("ext_left"), F.get("carried", F.lit(0)).alias("ext_right"),
        F.slice("carried", 2, F.greatest(F.size("carried") - 1, F.lit(0))).alias("left"), "before")
    dec = "decimal(38,0)"
    a = F.col("n").cast("decimal(18,0)")
    product = (a * a).cast(dec) * F.lit(1_000_000).cast("decimal(7,0)")
    order = F.size(F.split("key", "\0")) - 2

    def cut(k):
        l, r = F.get("left", k - 1), F.get("before", order - k - 1)
        under = (l.cast("decimal(18,0)") * r.cast("decimal(18,0)")).cast(dec)
        return F.struct(F.call_function("div", product.cast(dec), under).cast("long").alias("score"), k.alias("k"),
                        l.alias("l"), r.alias("r"))

    cuts = F.transform(F.sequence(F.lit(1), order - 1), cut)
    kept = both.filter((order > 1) & (100 * F.greatest("ext_left", "ext_right") < absorbed * F.col("n")))
    words = F.split("key", "\0")
    scored = kept.select(F.element_at(words, 1).alias("lang"), F.col("n").alias("a"), F.array_min(cuts).alias("best"),
                         F.concat_ws(" ", F.reverse(F.slice(words, F.lit(2), order))).alias("phrase"))
    scored = scored.select("lang", _plain(F.col("phrase")).alias("phrase"), "a", "best.l", "best.r", "best.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
        scored = (scored.withColumn("part", part)
                  .withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best)))
                  .filter(F.col("place") <= top).drop("part", "place"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(_plain(F.col("lang")).alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language over all documents."""
    return collocations(table(spark, sf_dir, "documents", "lang", "text"))
