"""Pair-set operators (P1-P4, P6-P8, P11, U1, K1-K3) and the composed builds.

All of them are projections, filters, per-group limits and global ranks; the only shuffles are
the per-source top-N (partial WindowGroupLimit before the exchange) and the range partitioning
behind the seeded shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paraforge.functions import text as T
from paraforge.session import materialise, write_once
from paraforge.operators.ranking import (cut_before_rank, first_n_per_group, seeded_shuffle, split_by_counts,
                                         split_by_ratio)

# Fixed values of the reference builds.
BAND = (0.15, 0.45)                                  # training-pair overlap band, inclusive
V1_CAPS = (("train", 5000), ("validation", 500), ("test", 500))
V2_TARGET, V2_COUNTS = 6000, (("train", 5000), ("validation", 500), ("test", 500))
V4_TARGET, V4_COUNTS = 12000, (("train", 10000), ("validation", 1000), ("test", 1000))
V5_TARGET, V6_TARGET = 6000, 15000
RATIOS = (("train", 0.85), ("validation", 0.075))    # the rest is test
SEED = 42
KEEP_THRESHOLD = 0.5                                 # P11: kept when overlap <= 0.5


def filter_positive(pairs: DataFrame, label: str = "label") -> DataFrame:
    """Keep label == 1 (a plain comparison, pushed into the Parquet scan)."""
    return pairs.filter(F.col(label) == 1)


def filter_category(lists: DataFrame, op: str = "==", value: str = "sentence", col: str = "category") -> DataFrame:
    """Keep ``category == value``, or the complement ``!= value`` where NULL counts as
    different (Python's ``None != "question"`` is True)."""
    if op == "==":
        return lists.filter(F.col(col) == value)
    if op == "!=":
        return lists.filter(~F.col(col).eqNullSafe(value))
    raise ValueError(f"unsupported op {op!r}")


def select_pair_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Keep only sentence1, sentence2 (and any bookkeeping columns asked for)."""
    return df.select(*keep, "sentence1", "sentence2")


def normalise_pair_columns(df: DataFrame, first: str | Column, second: str | Column,
                           keep: Sequence[str] = ()) -> DataFrame:
    """Map source-specific columns to sentence1/sentence2."""
    a = F.col(first) if isinstance(first, str) else first
    b = F.col(second) if isinstance(second, str) else second
    toks = []
    if isinstance(first, str) and isinstance(second, str) and \
            f"{first}_tokens" in df.columns and f"{second}_tokens" in df.columns:
        # token sets computed upstream travel with the texts
        toks = [F.col(f"{first}_tokens").alias("sentence1_tokens"), F.col(f"{second}_tokens").alias("sentence2_tokens")]
    return df.select(*keep, a.alias("sentence1"), b.alias("sentence2"), *toks)


def with_overlap(df: DataFrame, a: str = "sentence1", b: str = "sentence2", name: str = "overlap") -> DataFrame:
    """F2 as a column, computed once: the Generate keeps later filters from re-inlining it.
    Uses ``{a}_tokens``/``{b}_tokens`` when the token sets came precomputed (and drops them)."""
    ta, tb = f"{a}_tokens", f"{b}_tokens"
    if ta in df.columns and tb in df.columns:
        return df.select("*", F.explode(F.array(T.overlap_from_tokens(ta, tb))).alias(name)).drop(ta, tb)
    return df.select("*", F.explode(F.array(T.word_overlap(a, b))).alias(name))


def overlap_band(df: DataFrame, lo: float = BAND[0], hi: float = BAND[1], col: str = "overlap") -> DataFrame:
    """Keep lo <= overlap <= hi, both ends inclusive."""
    return df.filter(F.col(col).between(float(lo), float(hi)))


def training_examples(splits: DataFrame, prefix: str = T.PARAPHRASE_PREFIX) -> DataFrame:
    """Model input "paraphrase: " + sentence1, target sentence2; source columns dropped."""
    return splits.select("split", T.prompt_prefix("sentence1", prefix).alias("input_text"),
                         F.col("sentence2").alias("target_text"))


def partition_by_threshold(df: DataFrame, t: float = KEEP_THRESHOLD, col: str = "overlap") -> DataFrame:
    """Bucket 'kept' (overlap <= t) or 'dropped', in one pass."""
    return df.withColumn("bucket", F.when(F.col(col) <= float(t), "kept").otherwise("dropped"))


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate in the given order; ``source_rank`` records that order for later ties."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("source_rank", F.lit(i))
        out = f if out is None else out.unionByName(f)
    return out


def first_n_per_source(df: DataFrame, n: int, source: str | None = "source_rank", order: str = "ord") -> DataFrame:
    """K1: the first n qualifying rows in source order, per source; rows beyond a counted bound are
    dropped where they are, so that no task ranks more than about n."""
    group = [source] if source else []
    return first_n_per_group(cut_before_rank(df, group, order, n), group or None, [order], n)


@dataclass
class Prefix:
    """A source whose rows before any position can be had without the rest: ``rows(bound)`` gives those with ``ord`` below
    it, ``total`` is a position that all rows are below."""
    rows: Callable[[int], DataFrame]
    total: int


GROWTH = 8


def first_n_of_prefix(source: Prefix, qualify: Callable[[DataFrame], DataFrame], n: int, order: str = "ord") -> DataFrame:
    """K1 on a prefix: the first n qualifying rows, from ever longer prefixes until one holds them (or all rows). Each is
    ``GROWTH`` times the one before, so the rows read in vain are about a seventh of those read at the end, and
    what lies far beyond the n-th row is never evaluated. The qualifying rows are written once, then counted and cut."""
    bound = GROWTH * n
    while True:
        found = write_once(qualify(source.rows(min(bound, source.total))), "prefix")
        if bound >= source.total or found.count() >= n:
            return first_n_per_source(found, n, source=None, order=order)
        bound *= GROWTH


def _first_in_band(source: DataFrame | Prefix, in_band: Callable, n: int, lo: float, hi: float) -> DataFrame:
    if isinstance(source, Prefix):
        return first_n_of_prefix(source, lambda rows: in_band(rows, lo, hi), n)
    return first_n_per_source(in_band(source, lo, hi), n, source=None)


def cap_split(df: DataFrame, caps: Sequence[tuple[str, int]] = V1_CAPS, order: str = "ord") -> DataFrame:
    """K3: ``select(range(min(N, len)))`` per split (a split without a cap is dropped). Rows beyond a
    counted bound are dropped before ranking, as a split is few keys holding most of the rows."""
    cap = F.lit(0)
    for name, n in caps:
        cap = F.when(F.col("split") == name, n).otherwise(cap)
    w = Window.partitionBy("split").orderBy(order)
    near = cut_before_rank(df, ["split"], order, cap)
    return near.withColumn("_pf_rn", F.row_number().over(w)).filter(F.col("_pf_rn") <= cap).drop("_pf_rn")


def _materialise(capped: DataFrame) -> DataFrame:
    """Write a capped table (its size is bounded by the cap, not by the input) once, so that the
    seeded shuffle's range sampling and ranking passes do not each recompute the scan, split and
    pair join upstream."""
    return materialise(capped)


def proportional_counts(n: int) -> tuple:
    """Split counts of a build of any size in the reference's proportion of 10 : 1 : 1 (all rows used)."""
    return (("train", n * 10 // 12), ("validation", n // 12), ("test", n - n * 10 // 12 - n // 12))


def _require(df: DataFrame, n: int, what: str) -> None:
    have = df.count()
    if have < n:
        raise ValueError(f"{what}: need {n} rows, have {have}")


def qualifying_pairs(df: DataFrame, first: str | Column, second: str | Column, keep: Sequence[str],
                     lo: float, hi: float) -> DataFrame:
    """P4 -> F2 -> P7 on one source."""
    pairs = normalise_pair_columns(df, first, second, keep)
    return overlap_band(with_overlap(pairs), lo, hi)


# ---- composed builds ------------------------------------------------------------------------

def build_pairs_v1(sentence_pairs: DataFrame, caps=V1_CAPS) -> DataFrame:
    """B1: labelled sentence pairs by split -> positives -> cap per split -> two columns."""
    pos = filter_positive(sentence_pairs)
    return select_pair_columns(cap_split(pos, caps), keep=["split", "ord"])


def question_source(labelled_pairs: DataFrame, lo: float, hi: float) -> DataFrame:
    pos = filter_positive(labelled_pairs)
    return qualifying_pairs(pos, "question1", "question2", ["ord"], lo, hi)


def _declarative_pairs(lists: DataFrame) -> DataFrame:
    decl = filter_category(lists, "==", "sentence")
    return normalise_pair_columns(decl, "text", T.first_paraphrase(T.parse_paraphrase_list("paraphrases")), ["ord"])


def declarative_source(lists: DataFrame, lo: float, hi: float) -> DataFrame:
    return overlap_band(with_overlap(_declarative_pairs(lists)), lo, hi)


def build_pairs_v2(labelled_pairs: DataFrame | Prefix, target: int = V2_TARGET, counts=V2_COUNTS,
                   lo: float = BAND[0], hi: float = BAND[1], seed: int = SEED, strict: bool = True) -> DataFrame:
    """B2: positives in band, first ``target`` in source order, shuffled at build and shuffled
    again at split, then cut by counts. Both shuffles order by a keyed hash, so the result of
    the pair is the second (salted) permutation alone and only that one is computed. Too few rows
    raise (``strict``); ``counts=None`` cuts whatever there is in the proportion of the counts."""
    qual = _materialise(_first_in_band(labelled_pairs, question_source, target, lo, hi))
    again = seeded_shuffle(qual, ["ord"], f"{seed}:split", "r2")
    counts = counts or proportional_counts(qual.count())
    if strict:
        _require(again, sum(c for _, c in counts), "build_pairs_v2")
    return split_by_counts(again, "r2", counts).select("split", "ord", "sentence1", "sentence2", "overlap")


def build_pairs_v4(labelled_pairs: DataFrame | Prefix, target: int = V4_TARGET, counts=V4_COUNTS,
                   lo: float = BAND[0], hi: float = BAND[1], seed: int = SEED, strict: bool = True) -> DataFrame:
    """Like v2 with one shuffle."""
    qual = _materialise(_first_in_band(labelled_pairs, question_source, target, lo, hi))
    built = seeded_shuffle(qual, ["ord"], seed, "r1")
    counts = counts or proportional_counts(qual.count())
    if strict:
        _require(built, sum(c for _, c in counts), "build_pairs_v4")
    return split_by_counts(built, "r1", counts).select("split", "ord", "sentence1", "sentence2", "overlap")


def build_pairs_v5(labelled_pairs: DataFrame | Prefix, lists: DataFrame | Prefix, target: int = V5_TARGET, ratios=RATIOS,
                   lo: float = BAND[0], hi: float = BAND[1], seed: int = SEED, dedupe: bool = False) -> DataFrame:
    """B4 (v5 with 6,000 per source, v6 with 15,000): questions and declarative pairs, capped
    per source, unioned (questions first), shuffled, split 0.85 / 0.075 / rest."""
    if not dedupe:
        both = union_sources([_first_in_band(labelled_pairs, question_source, target, lo, hi),
                              _first_in_band(lists, declarative_source, target, lo, hi)])
    else:  # a pair's first occurrence may lie anywhere, so all rows are needed
        labelled_pairs, lists = (x.rows(x.total) if isinstance(x, Prefix) else x for x in (labelled_pairs, lists))
        both = union_sources([question_source(labelled_pairs, lo, hi), declarative_source(lists, lo, hi)])
        w = Window.partitionBy("sentence1", "sentence2").orderBy("source_rank", "ord")
        both = both.withColumn("_pf_d", F.row_number().over(w)).filter("_pf_d = 1").drop("_pf_d")
        both = first_n_per_source(both, target)
    capped = _materialise(both)   # at most 2 x target rows
    shuffled = seeded_shuffle(capped, ["source_rank", "ord"], seed, "r1")
    # counted from the shuffled table, which is materialised by the ranking checkpoint
    total = shuffled.select(F.count(F.lit(1))).scalar()
    out = split_by_ratio(shuffled, "r1", total, ratios)
    return out.select("split", "source_rank", "ord", "sentence1", "sentence2", "overlap")


def build_pairs_v6(labelled_pairs: DataFrame | Prefix, lists: DataFrame | Prefix, **kw) -> DataFrame:
    kw.setdefault("target", V6_TARGET)
    return build_pairs_v5(labelled_pairs, lists, **kw)


def build_stage_counts(labelled_pairs: DataFrame, lists: DataFrame, target: int = V5_TARGET,
                       lo: float = BAND[0], hi: float = BAND[1]) -> DataFrame:
    """A2 for B4: rows after each stage, as (stage, num_rows), in one union of aggregates. The rows of a source are
    scored once and kept as (ord, overlap); all its stages read these."""
    def n(df: DataFrame, stage: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).cast("long").alias("num_rows")).select(F.lit(stage).alias("stage"), "num_rows")

    def stages(scored: DataFrame, rows: str, name: str) -> DataFrame:
        kept = write_once(scored.select("ord", "overlap"), f"{name}-overlaps")
        in_band = overlap_band(kept, lo, hi)
        return (n(kept, f"{name}_{rows}").unionByName(n(in_band, f"{name}_in_band"))
                .unionByName(n(first_n_per_source(in_band, target, source=None), f"{name}_capped")))

    q = normalise_pair_columns(filter_positive(labelled_pairs), "question1", "question2", ["ord"])
    return stages(with_overlap(q), "positives", "question").unionByName(
        stages(with_overlap(_declarative_pairs(lists)), "rows", "declarative"))
