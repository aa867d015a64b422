"""H1 / H6 default: decoding strategies over a word lattice scored by a bigram table.

The rewriting model keeps or replaces each word of a text. At place i the choices are the word itself (choice 0) and the
``SUBSTITUTES`` most likely followers of the word before it. After choice a at place i - 1, choice b has probability

    COPY * [b is the word itself] + (1 - COPY) * share(a, b)

with ``share`` from the bigram table over cleaned words (letters only, lower case); a replacement never seen after a is impossible.

* *beam*: the ``BEAMS`` best prefixes by summed log-probability; the best at the end is the output.
* *diverse*: ``BEAMS`` groups of one prefix each; a group pays ``DIVERSITY`` for a choice that an earlier group took at the same place.
* *sample*: nucleus sampling. Probabilities to the power 1 / ``TEMPERATURE``, the smallest set of choices that holds ``TOP_P`` of the
  whole (a prefix sum in falling order), one drawn by an md5 of seed, text, sample number and place, so reruns agree.

Log-probabilities and weights are whole numbers (millionths), so the result depends on no order of addition.

The distinct texts are dealt to blocks of about ``BLOCK_WORDS`` words. A block meets the followers of its different words, asks the bigram
table once for each different pair of neighbouring choices, by a hash, and gets back only the pairs that the table has; so no row a place
and choice is shuffled. Decoding a text has work linear in its length. Texts of any length are decoded whole. The model itself is
never collected or broadcast.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import md5
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraforge.functions import text as T
from paraforge.operators.lexicon import top_predictions
from paraforge.session import write_once

# Fixed values of the decoding settings.
BEAMS, DIVERSITY = 4, 1.0
TEMPERATURE, TOP_P = 1.2, 0.9

COPY = 0.5
SUBSTITUTES = 3
SEED = 42
UNIT = 1_000_000
BLOCK_WORDS = 1 << 17
TEXTS_AT_ONCE = 256


def clean(words) -> F.Column:
    """Lower case, letters only: the form in the bigram table of words with single spaces between them."""
    return F.regexp_replace(F.lower(words), r"(?U)[^\p{L} ]", "")


def _blocks(texts: DataFrame) -> tuple[DataFrame, int]:
    """(block, text, words, clean) of each distinct text with a word, and the number of blocks. Words are joined by spaces."""
    rows = texts.select("text").distinct().withColumn("n", F.size(T.words("text")))
    rows = write_once(rows.filter("n > 0"), "decode-texts")
    total = rows.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS), min(rows.sparkSession.sparkContext.defaultParallelism, 16 * total // BLOCK_WORDS))
    block = F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int").alias("block")
    rows = rows.select(block, "text", F.array_join(T.words("text"), " ").alias("words"))
    return rows.withColumn("clean", clean("words")), blocks


def _pair_key(first, second) -> F.Column:
    """The hash of a pair of words from theirs."""
    return F.expr(f"{first} ^ (shiftleft({second}, 1) | shiftrightunsigned({second}, 63))")


def _vocabulary(rows: DataFrame, bigrams: DataFrame, substitutes: int) -> DataFrame:
    """(block, text, first, next): each different word of a block, its hash and its most likely followers (token, hash, score)."""
    best = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), "token", "score")))
    known = F.filter(best, lambda x: x["token"].isNotNull())
    followers = top_predictions(bigrams, "prev", substitutes).groupBy("prev").agg(F.transform(
        known, lambda x: F.struct(x["token"].alias("token"), F.xxhash64(x["token"]).alias("hash"), x["score"].alias("score"))).alias("next"))
    words = rows.select("block", F.explode(F.array_distinct(F.split("clean", " "))).alias("prev")).distinct()
    out = words.join(followers, "prev", "left").select("block", F.col("prev").alias("text"), F.xxhash64("prev").alias("first"), "next")
    return write_once(out, "decode-vocabulary")


def _together(blocks: int, *tables: DataFrame) -> DataFrame:
    """The rows of all tables, a block a partition; ``kind`` is the table's number, columns that it lacks are null."""
    out = tables[0].withColumn("kind", F.lit(0))
    for i, df in enumerate(tables[1:], 1):
        out = out.unionByName(df.withColumn("kind", F.lit(i)), allowMissingColumns=True)
    rest = [c for c in out.columns if c not in ("block", "kind")]
    return out.select("block", "kind", *rest).repartitionById(blocks, "block").sortWithinPartitions("block")


def _each_block(batches):
    """(block, table) of batches that are sorted by their first column, the block."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        block = np.asarray(batch.column(0))
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, z in zip(cuts, cuts[1:]):
            if a == z:
                continue
            if held and block[a] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = block[a]
            held.append(batch.slice(a, z - a))
    if held:
        yield last, pa.Table.from_batches(held)


def _kinds(table: pa.Table, n: int) -> list[pa.Table]:
    kind = np.asarray(table.column("kind"))
    return [table.filter(pa.array(kind == i)) for i in range(n)]


class Choices:
    """The choices at all places of a block's texts as numbers of words: the word itself and the followers of the word before."""

    def __init__(self, texts: pa.Table, vocabulary: pa.Table, substitutes: int):
        number = {w: i for i, w in enumerate(vocabulary.column("text").to_pylist())}
        n = len(number)
        lists = vocabulary.column("next").combine_chunks()
        sizes = np.asarray(lists.value_lengths().fill_null(0))
        found = lists.flatten()
        tokens, hashes = found.field("token").to_pylist(), np.asarray(found.field("hash"))
        follower = np.array([number.setdefault(t, len(number)) for t in tokens], dtype=np.int64)
        row, column = np.repeat(np.arange(n), sizes), np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        following, scores = np.full((n, substitutes), -1, dtype=np.int64), np.zeros((n, substitutes))
        following[row, column], scores[row, column] = follower, np.asarray(found.field("score"))
        self.names = list(number)
        self.hash = np.zeros(len(number), dtype=np.int64)
        self.hash[:n] = np.asarray(vocabulary.column("first"))
        self.hash[follower] = hashes
        words = [c.split(" ") for c in texts.column("clean").to_pylist()]
        self.edge = np.cumsum([0, *map(len, words)])
        own = np.fromiter((number[w] for some in words for w in some), np.int64, self.edge[-1])
        before = np.concatenate([own[:1], own[:-1]])
        first = np.zeros(len(own), dtype=bool)
        first[self.edge[:-1]] = True
        subs = following[before]
        out = (subs < 0) | (subs == own[:, None]) | first[:, None]
        order = np.argsort(out, axis=1, kind="stable")
        self.at = np.column_stack([own, np.take_along_axis(np.where(out, -1, subs), order, axis=1)])
        self.scores = np.take_along_axis(scores[before], order, axis=1)
        self.later = np.flatnonzero(~first)

    def pairs(self):
        """(a, b, places, key, hash of the first word) of the neighbouring choices; after choice 0 only choice 0, as the shares of
        its followers are known."""
        for a in range(self.at.shape[1]):
            for b in range(self.at.shape[1] if a else 1):
                x, y = self.at[self.later - 1, a], self.at[self.later, b]
                both = (x >= 0) & (y >= 0)
                first, second = self.hash[x[both]], self.hash[y[both]].view(np.uint64)
                turned = (second << np.uint64(1)) | (second >> np.uint64(63))
                yield a, b, self.later[both], first ^ turned.view(np.int64), first

    def shares(self, known: pa.Table) -> np.ndarray:
        """The share of each choice after each choice at the place before, 0 where the bigram table has none."""
        key, first, score = (np.asarray(known.column(c)) for c in ("key", "first", "score"))
        order = np.lexsort((first, key))
        key, first, score = key[order], first[order], score[order]
        out = np.zeros((len(self.at), self.at.shape[1], self.at.shape[1]))
        out[:, 0, 1:] = np.where(self.at[:, 1:] >= 0, self.scores, 0.0)
        for a, b, places, asked, word in self.pairs():
            at = np.searchsorted(key, asked)
            for _ in range(2):  # two pairs may have one key
                fits = at < len(key)
                fits[fits] = (key[at[fits]] == asked[fits]) & (first[at[fits]] == word[fits])
                out[places[fits], a, b] = score[at[fits]]
                at = at + 1
        return out


@lru_cache(maxsize=1 << 16)
def _cost(p: float) -> int:
    return -round(log(p) * UNIT)


@lru_cache(maxsize=1 << 16)
def _weight(p: float, temperature: float) -> int:
    return round(p ** (1 / temperature) * UNIT)


class Lattice:
    """The choices of one text and their probabilities after each choice at the place before."""

    def __init__(self, text: str, words: list, subs: list, steps: list | None):
        self.text, self.words, self.subs = text, words, subs
        self.table: list | None = None
        self.shares: dict = {}
        for step in steps or []:
            self.shares.setdefault((step["place"], step["a"]), {})[step["b"]] = step["share"]
        self.known_costs: dict = {}
        self.known_nuclei: dict = {}

    @classmethod
    def placed(cls, text: str, words: list, subs: list, table: list) -> Lattice:
        """From shares as lists by place, choice before and choice."""
        lattice = cls(text, words, subs, None)
        lattice.table = table
        return lattice

    def odds(self, place: int, before: int) -> list[tuple[int, float]]:
        """(choice, probability) of the possible choices, by choice."""
        if place == 0:
            return [(0, 1.0)]
        if self.table is not None:
            share = self.table[place][before]
        else:
            found = self.shares.get((place, before), {})
            share = [found.get(b, 0.0) for b in range(len(self.subs[place]) + 1)]
        out = [(0, COPY + (1 - COPY) * share[0])]
        for b in range(1, len(self.subs[place]) + 1):
            if share[b] > 0:
                out.append((b, (1 - COPY) * share[b]))
        return out

    def costs(self, place: int, before: int) -> list[tuple[int, int]]:
        """(choice, minus log-probability), worked out once."""
        found = self.known_costs.get((place, before))
        if found is None:
            found = self.known_costs[place, before] = [(b, _cost(p)) for b, p in self.odds(place, before)]
        return found

    def nucleus(self, place: int, before: int, temperature: float, share: int) -> tuple[list[tuple[int, int]], int]:
        """(weight, choice) of the choices that may be drawn, in falling order, and the sum of weights."""
        weights = sorted([(-_weight(p, temperature), b) for b, p in self.odds(place, before)])
        total, kept, below = -sum([w for w, _ in weights]), [], 0
        for w, b in weights:
            if below * UNIT >= total * share:
                break
            kept.append((-w, b))
            below -= w
        return kept, below

    def shown(self, path: list[int]) -> str:
        return " ".join(self.words[i] if b == 0 else self.subs[i][b - 1] for i, b in enumerate(path))


def beam(lattice: Lattice, beams: int = BEAMS) -> list[int]:
    """The best path that is always among the ``beams`` best prefixes; ties go to the earlier prefix, then choice."""
    states = [(0, 0, 0)]
    history = []
    for place in range(len(lattice.words)):
        grown = [(cost + more, rank, b) for rank, (cost, _, last) in enumerate(states) for b, more in lattice.costs(place, last)]
        states = sorted(grown)[:beams]
        history.append(states)
    path, rank = [], 0
    for states in reversed(history):
        path.append(states[rank][2])
        rank = states[rank][1]
    return path[::-1]


def diverse(lattice: Lattice, groups: int = BEAMS, penalty: float = DIVERSITY) -> list[int]:
    """The best of ``groups`` greedy paths that avoid each other's choices."""
    costs, paths, fine = [0] * groups, [[] for _ in range(groups)], round(penalty * UNIT)
    for place in range(len(lattice.words)):
        taken: dict[int, int] = {}
        for g in range(groups):
            options = lattice.costs(place, paths[g][-1] if paths[g] else 0)
            costs[g], b = min((costs[g] + more + fine * taken.get(b, 0), b) for b, more in options)
            paths[g].append(b)
            taken[b] = taken.get(b, 0) + 1
    return paths[min(range(groups), key=lambda g: (costs[g], g))]


def sample(lattice: Lattice, number: int, seed: int | str = SEED, temperature: float = TEMPERATURE, top_p: float = TOP_P) -> list[int]:
    """One path drawn by nucleus sampling; equal inputs give equal paths."""
    path, last, share = [], 0, round(top_p * UNIT)
    start = md5(f"{seed}:{lattice.text}:{number}:".encode())
    nuclei = lattice.known_nuclei.setdefault((temperature, share), {})
    for place in range(len(lattice.words)):
        kept, total = nuclei.get((place, last)) or nuclei.setdefault((place, last), lattice.nucleus(place, last, temperature, share))
        if len(kept) == 1:
            last = kept[0][1]
        else:
            drawn = start.copy()
            drawn.update(b"%d" % place)
            draw = int.from_bytes(drawn.digest()[:4], "big") * total >> 32
            for w, last in kept:
                draw -= w
                if draw < 0:
                    break
        path.append(last)
    return path


def _outputs(samples: int, searches: bool) -> list[tuple[str, int]]:
    """(strategy, idx) of the outputs of a text, in their order."""
    return [("beam", 0), ("diverse", 0)] * searches + [("sample", n) for n in range(samples)]


def decoded_lists(texts: DataFrame, bigrams: DataFrame, samples: int = 3, searches: bool = True, seed: int | str = SEED,
                  substitutes: int = SUBSTITUTES) -> DataFrame:
    """(text, candidates): for each distinct text with a word its outputs as an array, in the order of ``_outputs``."""
    def asked(batches):
        for block, table in _each_block(batches):
            rows, vocabulary = _kinds(table, 2)
            keys = [np.unique(key) for _, _, _, key, _ in Choices(rows, vocabulary, substitutes).pairs()]
            key = np.unique(np.concatenate(keys))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), block, np.int32)), pa.array(key)], names=["block", "key"])

    def run(batches):
        for _, table in _each_block(batches):
            rows, vocabulary, known = _kinds(table, 3)
            del table
            choices = Choices(rows, vocabulary, substitutes)
            shares, names, out = choices.shares(known), choices.names, []
            for i, (text, words) in enumerate(zip(rows.column("text").to_pylist(), rows.column("words").to_pylist())):
                here = slice(choices.edge[i], choices.edge[i + 1])
                subs = [[names[j] for j in some if j >= 0] for some in choices.at[here, 1:].tolist()]
                lattice = Lattice.placed(text, words.split(" "), subs, shares[here].tolist())
                paths = [beam(lattice), diverse(lattice)] if searches else []
                paths += [sample(lattice, n, seed) for n in range(samples)]
                out.append((text, [lattice.shown(path) for path in paths]))
                if len(out) == TEXTS_AT_ONCE or i + 1 == rows.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.string()),
                                                      pa.array([c for _, c in out], pa.list_(pa.string()))], names=["text", "candidates"])
                    out = []

    bigrams = write_once(bigrams.select("prev", "token", "score").filter("prev IS NOT NULL"), "decode-bigrams")
    rows, blocks = _blocks(texts)
    vocabulary = _vocabulary(rows, bigrams, substitutes)
    pairs = _together(blocks, rows.select("block", "clean"), vocabulary).mapInArrow(asked, "block int, key long")
    keyed = bigrams.filter("token IS NOT NULL").select(F.xxhash64("prev").alias("first"), F.xxhash64("token").alias("second"), "score")
    known = pairs.join(keyed.select(_pair_key("first", "second").alias("key"), "first", "score"), "key")
    return _together(blocks, rows, vocabulary, known).mapInArrow(run, "text string, candidates array<string>")


def _unrolled(lists: DataFrame, samples: int, searches: bool, *columns: str) -> DataFrame:
    """The given columns, strategy, idx and candidate: a row an output."""
    made = F.array(*[F.struct(F.lit(s).alias("strategy"), F.lit(i).alias("idx")) for s, i in _outputs(samples, searches)])
    if not _outputs(samples, searches):
        made = F.array().cast("array<struct<strategy:string,idx:int>>")
    return lists.select(*columns, F.posexplode("candidates").alias("_pf_at", "candidate")).withColumn("_pf_made", F.get(made, F.col("_pf_at"))).select(
        *columns, F.col("_pf_made.strategy").alias("strategy"), F.col("_pf_made.idx").alias("idx"), "candidate")


def decode(texts: DataFrame, bigrams: DataFrame, samples: int = 3, searches: bool = True, seed: int | str = SEED) -> DataFrame:
    """H6: (text, strategy, idx, candidate) for each distinct text with a word: one output of beam and of diverse beam search
    (unless ``searches`` is false) and ``samples`` of nucleus sampling."""
    return _unrolled(decoded_lists(texts, bigrams, samples, searches, seed), samples, searches, "text")


def sampled_candidates(df: DataFrame, bigrams: DataFrame, key: str = "sentence_id", text: str = "original", n: int = 8,
                       seed: int | str = SEED) -> DataFrame:
    """H1: (key, original, gen_idx, text): ``n`` sampled rewrites of each text, decoded once per distinct text; the lists of
    rewrites meet the texts, and are unrolled after."""
    found = decoded_lists(df.select(F.col(text).alias("text")), bigrams, n, False, seed).withColumnRenamed("text", "original")
    met = df.select(key, F.col(text).alias("original")).join(found, "original")
    return _unrolled(met, n, False, key, "original").select(key, "original", F.col("idx").alias("gen_idx"), F.col("candidate").alias("text"))


def decoded_strategies(df: DataFrame, bigrams: DataFrame, key: str = "sentence_id", text: str = "original", with_tokens: bool = False) -> DataFrame:
    """H6: (key, original, strategy, idx, text) of all strategies. ``with_tokens`` adds ``original_tokens``, found once per text."""
    found = decoded_lists(df.select(F.col(text).alias("text")), bigrams).withColumnRenamed("text", "original")
    met = df.select(key, F.col(text).alias("original")).join(found, "original")
    extra = ["original_tokens"] if with_tokens else []
    met = met.withColumn("original_tokens", T.tokens("original")) if with_tokens else met
    return _unrolled(met, 3, True, key, "original", *extra).select(
        key, "original", "strategy", "idx", F.col("candidate").alias("text"), *extra)
