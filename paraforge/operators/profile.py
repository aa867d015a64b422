"""Profiling and evaluation (A1, A3, A4, A7-A9, J4-J6, K4): aggregates with map-side combine,
index quantiles over a global rank, and small reports.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraforge.operators.ranking import with_running_sum

QUANTILE_SAMPLE = 2000      # the reference measures the first 2,000 positives
CONFIDENCE_THRESHOLDS = (0.85,)


def value_counts(df: DataFrame, col: str, order: str = "ord") -> DataFrame:
    """A1: frequency of each value; ties are ordered by first appearance (``first_ord``).
    Sort with ``orderBy(desc('count'), 'first_ord')`` when a listing is wanted."""
    return df.groupBy(F.col(col).alias("value")).agg(
        F.count(F.lit(1)).cast("long").alias("count"), F.min(order).cast("long").alias("first_ord"))


def sorted_value_counts(df: DataFrame, col: str, order: str = "ord") -> DataFrame:
    return value_counts(df, col, order).orderBy(F.desc("count"), "first_ord")


def keep_rate(bucketed: DataFrame, bucket: str = "bucket") -> DataFrame:
    """A3: kept / dropped counts and the kept share (NULL on an empty input, not an error)."""
    return bucketed.agg(
        F.count_if(F.col(bucket) == "kept").cast("long").alias("kept"),
        F.count_if(F.col(bucket) == "dropped").cast("long").alias("dropped"),
        F.count(F.lit(1)).cast("long").alias("total"),
    ).withColumn("kept_rate", F.try_divide(F.col("kept").cast("double"), F.col("total").cast("double")))


def index_quantiles(df: DataFrame, col: str = "overlap", order: str = "ord", extra=()) -> DataFrame:
    """A4: min, s[n//4], s[n//2], s[3n//4], max of the sorted values (the reference's index
    rule, not an interpolating percentile).

    The full table is never sorted: values are counted (``groupBy(value)``, map-side combined;
    the distinct values are usually few), a running sum over that narrow table gives the index
    range each value covers, and the value covering each wanted index is picked. ``order`` is
    not needed (equal values are interchangeable). ``extra`` adds aggregates over the counted
    table, whose columns are ``_v`` (value) and ``_c`` (its count)."""
    counts = df.select(F.col(col).alias("_v")).filter(F.col("_v").isNotNull()) \
               .groupBy("_v").agg(F.count(F.lit(1)).alias("_c"))
    cum = with_running_sum(counts, ["_v"], "_c", "_before")   # checkpointed narrow table
    n = cum.select(F.sum("_c")).scalar()

    def at(idx) -> F.Column:
        covers = (F.col("_before") <= idx) & (idx < F.col("_before") + F.col("_c"))
        return F.max(F.when(covers, F.col("_v")))

    return cum.agg(
        F.coalesce(F.sum("_c"), F.lit(0)).cast("long").alias("n"),
        F.min("_v").alias("min"),
        at(F.floor(n / 4)).alias("q1"),
        at(F.floor(n / 2)).alias("median"),
        at(F.floor(n * 3 / 4)).alias("q3"),
        F.max("_v").alias("max"),
        *extra,
    )


def confidence_rate(selected: DataFrame, flag: str = "confident", by: Sequence[str] = ()) -> DataFrame:
    """Sentences with a trusted rewrite, count and share (optionally per group)."""
    agg = [F.count_if(F.col(flag)).cast("long").alias("confident"),
           F.count(F.lit(1)).cast("long").alias("total")]
    out = selected.groupBy(*by).agg(*agg) if by else selected.agg(*agg)
    return out.withColumn("rate", F.try_divide(F.col("confident").cast("double"), F.col("total").cast("double")))


def threshold_cross(df: DataFrame, thresholds: Sequence[float] = CONFIDENCE_THRESHOLDS,
                    name: str = "threshold") -> DataFrame:
    """Every row against every threshold: a Generate over a literal array (no join)."""
    return df.select("*", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias(name))


def paragraph_rejoin_nested(arr, field: str = "paraphrased") -> F.Column:
    """A9 (nested form, no shuffle): join the per-sentence outputs with one space, in order."""
    return F.array_join(F.transform(arr, lambda s: s[field]), " ")


def paragraph_rejoin(rows: DataFrame, key: str, pos: str, text: str, name: str = "paragraph") -> DataFrame:
    """A9 (long form): one shuffle on ``key``; the group is one original paragraph."""
    return rows.groupBy(key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t")))),
                                 lambda s: s["t"]), " ").alias(name))


def compare_models(sel_a: DataFrame, sel_b: DataFrame, key: str = "sentence_id",
                   cols: Sequence[str] = ("paraphrased", "confident")) -> DataFrame:
    """The best output of two runs side by side."""
    a = sel_a.select(key, *[F.col(c).alias(f"{c}_a") for c in cols])
    b = sel_b.select(key, *[F.col(c).alias(f"{c}_b") for c in cols])
    return a.join(b, key)


def expected_vs_model(examples: DataFrame, outputs: DataFrame, key: str = "ord", k: int | None = 10) -> DataFrame:
    """Stored target beside the model output for the first k examples in source order."""
    joined = examples.join(outputs, key)
    return joined.orderBy(key).limit(k) if k else joined
