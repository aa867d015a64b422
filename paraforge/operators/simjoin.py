"""J1 + F2 + P7: in-group pairs whose token-set Jaccard lies in a band, without emitting all pairs.

The reference takes ``itertools.combinations`` of every cluster and filters by overlap. That is
quadratic per cluster, and one cluster may hold a large share of all rows.

``band_pairs`` is for groups whose items are rows, an exact set-similarity join:

* Within a group, order tokens by (frequency in the group, token). Two sets A, B with
  J(A, B) >= lo share at least ceil(lo * |A|) tokens, so they share a token among the first
  ``|A| - ceil(lo * |A|) + 1`` tokens of A (its *prefix*) and likewise for B. Joining prefix
  tokens on (group, token) therefore finds every qualifying pair; rare tokens come first, so the
  most common words of a group are the first to be left out (at a low ``lo`` few are).
* A length filter (lo * |A| <= |B| <= |A| / lo) and a position filter drop pairs at the join: if
  places i of A and j of B meet first, at most ``1 + min(|A| - i, |B| - j)`` tokens are
  shared, and ``lo / (1 + lo) * (|A| + |B|)`` are needed.
* The postings of a token that more than ``POSTINGS`` items of a group share are dealt to blocks, and
  each pair of blocks is a join key of its own, so no task meets a whole posting list.
* Candidate pairs are de-duplicated, then verified with the exact Jaccard on the full token sets.

``band_pairs_in_rows`` is for groups that lie inside one row (a document's sentences): nothing is
shuffled. The JVM splits and hashes the words; an Arrow pass counts shared words of all pairs of a row
with matrix products over blocks of ``ROW_BLOCK`` sentences and ``TOKEN_BLOCK`` words, so its memory does not grow with
the row's pairs.

Valid for ``lo > 0`` (with ``lo <= 0`` every pair qualifies and the answer itself is all pairs).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paraforge.functions import text as T
from paraforge.session import write_once

_EPS = 1e-9  # keeps the bounds conservative against float rounding of lo * n
POSTINGS = 512
ROW_BLOCK, TOKEN_BLOCK = 1024, 4096


def _check(lo: float) -> None:
    if lo <= 0:
        raise ValueError("pairs in a band need lo > 0; with lo <= 0 every pair in a group qualifies")


def _token_set(sentence) -> F.Column:
    """The distinct words of a sentence as 64-bit hashes."""
    return F.array_distinct(F.transform(T.word_tokens(sentence), lambda w: F.xxhash64(w)))


def token_prefixes(base: DataFrame, lo: float) -> DataFrame:
    """(g, p, n, tok, rn, df): the first n - ceil(lo*n) + 1 tokens of each item by (frequency df in
    the group, token), at place rn of the item's n; a token of one item only meets nothing and is left out."""
    exploded = base.select("g", "p", "n", F.explode("toks").alias("tok"))
    freq = exploded.groupBy("g", "tok").agg(F.count(F.lit(1)).alias("df"))
    w = Window.partitionBy("g", "p").orderBy("df", "tok")
    plen = F.col("n") - F.ceil(F.col("n") * F.lit(float(lo)) - F.lit(_EPS)) + 1
    ranked = exploded.join(freq, ["g", "tok"]).withColumn("rn", F.row_number().over(w))
    return ranked.filter((F.col("rn") <= plen) & (F.col("df") > 1)).select("g", "p", "n", "tok", "rn", "df")


def candidate_pairs(prefixes: DataFrame, lo: float, postings: int = POSTINGS) -> DataFrame:
    """(g, p1, p2) with p1 < p2: the pairs that share a prefix token and pass the length and position filters."""
    blocks = F.ceil(F.col("df") / postings).cast("int")
    dealt = prefixes.withColumn("nb", blocks).withColumn("b", F.pmod(F.xxhash64("p"), F.col("nb")).cast("int"))
    a = dealt.select("g", "tok", F.col("b").alias("bi"), F.explode(F.sequence("b", F.col("nb") - 1)).alias("bj"),
                     F.col("p").alias("pa"), F.col("n").alias("na"), F.col("rn").alias("ra"))
    b = dealt.select("g", "tok", F.explode(F.sequence(F.lit(0), "b")).alias("bi"), F.col("b").alias("bj"),
                     F.col("p").alias("pb"), F.col("n").alias("nb"), F.col("rn").alias("rb"))
    need = (F.col("na") + F.col("nb")) * F.lit(lo / (1 + lo)) - F.lit(_EPS)
    met = a.join(b, ["g", "tok", "bi", "bj"]).where(
        # inside a block each pair is met twice, across blocks once
        ((F.col("pa") < F.col("pb")) | ((F.col("bi") < F.col("bj")) & (F.col("pa") > F.col("pb"))))
        & (F.col("nb") >= F.col("na") * F.lit(float(lo)) - F.lit(_EPS))
        & (F.col("na") >= F.col("nb") * F.lit(float(lo)) - F.lit(_EPS))
        & (1 + F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb")) >= need))
    return met.select("g", F.least("pa", "pb").alias("p1"), F.greatest("pa", "pb").alias("p2")).distinct()


def band_pairs(items: DataFrame, group: str, pos: str, text: str, lo: float, hi: float) -> DataFrame:
    """(group, pos1, pos2, sentence1, sentence2, overlap) for pos1 < pos2 in the same group
    with lo <= overlap <= hi (both ends inclusive)."""
    _check(lo)
    # Split and tokenised once: every branch below reads this table.
    base = items.select(F.col(group).alias("g"), F.col(pos).alias("p"), F.col(text).alias("s"))
    base = base.select("*", F.explode(F.array(_token_set("s"))).alias("toks")).withColumn("n", F.size("toks"))
    base = write_once(base.filter(F.col("n") > 0), "pair-items")  # an empty side has overlap 0.0 < lo
    cand = candidate_pairs(token_prefixes(base, lo), lo)

    # verified on the hashed sets alone; texts join only the pairs that stay
    left = base.select("g", F.col("p").alias("p1"), F.col("toks").alias("t1"))
    right = base.select("g", F.col("p").alias("p2"), F.col("toks").alias("t2"))
    # explode(array(x)) keeps the Jaccard in one Generate, so the band filter above it does not
    # get the expression inlined (and evaluated) once per comparison.
    scored = cand.join(left, ["g", "p1"]).join(right, ["g", "p2"]).select(
        "g", "p1", "p2", F.explode(F.array(T.overlap_from_tokens("t1", "t2"))).alias("overlap"))
    kept = scored.filter(F.col("overlap").between(float(lo), float(hi)))
    first = base.select("g", F.col("p").alias("p1"), F.col("s").alias("sentence1"))
    second = base.select("g", F.col("p").alias("p2"), F.col("s").alias("sentence2"))
    return kept.join(first, ["g", "p1"]).join(second, ["g", "p2"]).select(
        F.col("g").alias(group), F.col("p1").alias("pos1"), F.col("p2").alias("pos2"),
        "sentence1", "sentence2", "overlap")


def _pairs_of_row(tokens: np.ndarray, sizes: np.ndarray, lo: float, hi: float, row_block: int, token_block: int):
    """(i, j, overlap) arrays, i < j, of the sentence pairs in the band; ``tokens`` holds the sentences' words one
    after the other, ``sizes`` the number of words of each."""
    _, code, df = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = df[code] > 1
    number = np.cumsum(df > 1) - 1
    code, owner = number[code[shared]], np.repeat(np.arange(len(sizes)), sizes)[shared]
    words = int(number[-1]) + 1 if len(number) else 0
    if words == 0:
        return
    by_word = np.argsort(code, kind="stable")
    code, owner = code[by_word], owner[by_word]
    cuts = np.searchsorted(code, np.arange(0, words, token_block))
    cuts = np.append(cuts, len(code))

    def matrix(rows: int, chunk: int) -> np.ndarray:
        own, words_of = owner[cuts[chunk]:cuts[chunk + 1]], code[cuts[chunk]:cuts[chunk + 1]] - chunk * token_block
        inside = (own >= rows) & (own < rows + row_block)
        out = np.zeros((min(row_block, len(sizes) - rows), min(token_block, words - chunk * token_block)), dtype=np.float32)
        out[own[inside] - rows, words_of[inside]] = 1
        return out

    for a in range(0, len(sizes), row_block):
        for b in range(a, len(sizes), row_block):
            both = 0
            for chunk in range(len(cuts) - 1):
                left = matrix(a, chunk)
                both = both + left @ (left if a == b else matrix(b, chunk)).T
            i, j = np.nonzero(both)
            i, j, n = i + a, j + b, both[i, j].astype(np.float64)
            ordered = i < j
            i, j, n = i[ordered], j[ordered], n[ordered]
            overlap = n / (sizes[i] + sizes[j] - n)
            kept = (overlap >= lo) & (overlap <= hi)
            yield i[kept], j[kept], overlap[kept]


def band_pairs_in_rows(rows: DataFrame, group: str, sentences: str, lo: float, hi: float) -> DataFrame:
    """The result of ``band_pairs`` for groups that are one row each, ``sentences`` being an array of strings; positions
    count from 0. A null array has no pairs; rows with equal group values are groups of their own."""
    _check(lo)
    kind = rows.schema[group].dataType.simpleString()
    hashed = rows.select(F.col(group).alias("g"), F.coalesce(sentences, F.array().cast("array<string>")).alias("s")).select(
        "g", "s", F.transform("s", _token_set).alias("t"))

    blocks = ROW_BLOCK, TOKEN_BLOCK

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            groups, texts, sets = batch.columns
            outer, inner = sets.offsets.to_numpy(), sets.values.offsets.to_numpy()
            flat, text_at = sets.values.values.to_numpy(), texts.offsets.to_numpy()
            for r in range(batch.num_rows):
                words = inner[outer[r]:outer[r + 1] + 1].astype(np.int64)
                if len(words) < 3:
                    continue
                for i, j, overlap in _pairs_of_row(flat[words[0]:words[-1]], np.diff(words), lo, hi, *blocks):
                    if len(i):
                        yield pa.RecordBatch.from_arrays([
                            groups.slice(r, 1).take(pa.array(np.zeros(len(i), dtype=np.int64))), pa.array(i), pa.array(j),
                            texts.values.take(pa.array(i + text_at[r])), texts.values.take(pa.array(j + text_at[r])),
                            pa.array(overlap)], names=["g", "pos1", "pos2", "sentence1", "sentence2", "overlap"])

    out = hashed.mapInArrow(run, f"g {kind}, pos1 long, pos2 long, sentence1 string, sentence2 string, overlap double")
    return out.withColumnRenamed("g", group)
