"""Order-dependent operators: global rank, rank within group, seeded shuffle, splits,
first-N per group (K1-K8).

Source order is semantic in the reference ("first N", positional splits). Spark tables have no
order, so every order here is an explicit total order over columns, and every dense position is
computed without a single-partition Window:

* ``with_global_rank`` range-partitions on the order, numbers rows inside each partition
  (``monotonically_increasing_id`` encodes partition index and local row index), and adds the
  per-partition offsets. The offsets table has one row per partition, so it is broadcast with a
  size bound that does not grow with the data. The tagged table is written once with
  ``checkpoint()`` (to the shared ``spark.checkpoint.dir``) before it is read twice: a range
  exchange planned twice samples its bounds twice (the sampler is seeded by RDD id), and
  column pruning keeps the two reads from sharing one exchange, so without the checkpoint the
  counts and the rows could come from different partitionings. The checkpoint also cuts the
  lineage, so a lost executor does not recompute (and re-sample) it.
* ``with_rank_in_group`` derives a 0-based position inside a group from the global rank minus the
  group's first rank (a map-side-combined ``min``), so a hot group is spread over many range
  partitions instead of landing in one Window task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paraforge.session import materialise, write_once

_LOCAL_BITS = 33  # monotonically_increasing_id = partition index << 33 | row index in partition


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _num_partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _range(df: DataFrame, order_cols, num_partitions: int | None) -> DataFrame:
    """Range-partition on the order. Without an explicit count the session's shuffle partitions
    apply and AQE may coalesce neighbouring ranges (still contiguous ranges, so partition index
    order is the global order); the tagged result is materialised before it is read twice."""
    if num_partitions:
        return df.repartitionByRange(num_partitions, *order_cols)
    return df.repartitionByRange(*order_cols)


def with_global_rank(df: DataFrame, order: Sequence, name: str = "rank",
                     num_partitions: int | None = None) -> DataFrame:
    """Add a dense 0-based rank by ``order`` (which must be a total order on the rows)."""
    order_cols = _cols(order)
    ranged = _range(df, order_cols, num_partitions).sortWithinPartitions(*order_cols)
    tagged = ranged.withColumn("_pf_mid", F.monotonically_increasing_id())
    tagged = tagged.withColumn("_pf_pid", F.shiftright("_pf_mid", _LOCAL_BITS))
    tagged = materialise(tagged)
    counts = tagged.groupBy("_pf_pid").agg(F.count(F.lit(1)).alias("_pf_n"))
    # One row per range partition (bounded by n): an unpartitioned Window is fine here.
    before = Window.orderBy("_pf_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pf_pid", F.coalesce(F.sum("_pf_n").over(before), F.lit(0)).alias("_pf_off"))
    local = F.col("_pf_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    out = tagged.join(F.broadcast(offsets), "_pf_pid")
    return out.withColumn(name, (F.col("_pf_off") + local).cast("long")).drop("_pf_mid", "_pf_pid", "_pf_off")


def with_running_sum(df: DataFrame, order: Sequence, value: str, name: str = "offset",
                     num_partitions: int | None = None) -> DataFrame:
    """Add the exclusive running sum of ``value`` along ``order`` (a total order).

    Meant for narrow tables (one row per text or turn): range-partition, sum inside each range
    partition with a Window partitioned by the partition id (partition sizes are balanced by the
    range bounds, so a hot group spans many of them), then add per-partition offsets from a
    table of one row per partition (broadcast, bounded by the partition count). The tagged table
    is checkpointed so that both reads see one partitioning.
    """
    order_cols = _cols(order)
    tagged = (_range(df, order_cols, num_partitions).sortWithinPartitions(*order_cols)
              .withColumn("_pf_pid", F.spark_partition_id()))
    tagged = materialise(tagged)
    inside = Window.partitionBy("_pf_pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    summed = tagged.withColumn("_pf_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    totals = tagged.groupBy("_pf_pid").agg(F.sum(value).alias("_pf_tot"))
    # One row per range partition (bounded by n): an unpartitioned Window is fine here.
    before = Window.orderBy("_pf_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pf_pid", F.coalesce(F.sum("_pf_tot").over(before), F.lit(0)).alias("_pf_off"))
    out = summed.join(F.broadcast(offsets), "_pf_pid")
    return out.withColumn(name, (F.col("_pf_off") + F.col("_pf_in")).cast("long")).drop("_pf_pid", "_pf_in", "_pf_off")


def with_rank_in_group(df: DataFrame, group: Sequence[str], order: Sequence, name: str = "pos",
                       num_partitions: int | None = None) -> DataFrame:
    """Add a dense 0-based position inside each group, ordered by ``order``.

    ``group + order`` must be a total order. Skew-safe: no Window over the group key.
    """
    g = "_pf_g"
    ranked = with_global_rank(df, [*group, *order], g, num_partitions)
    starts = ranked.groupBy(*group).agg(F.min(g).alias("_pf_g0"))
    out = ranked.join(starts, list(group))
    return out.withColumn(name, (F.col(g) - F.col("_pf_g0")).cast("long")).drop(g, "_pf_g0")


def seeded_order_key(key_cols: Sequence, seed: int | str) -> Column:
    """K5: a pseudo-random but reproducible order key: md5 of the key and the seed.

    Independent of partitioning and of Spark version; DuckDB computes the same md5.
    """
    parts = []
    for c in _cols(key_cols):
        parts.extend([c.cast("string"), F.lit(":")])
    parts.append(F.lit(str(seed)))
    return F.md5(F.concat(*parts))


def seeded_shuffle(df: DataFrame, key_cols: Sequence, seed: int | str = 42, name: str = "shuffle_rank",
                   num_partitions: int | None = None) -> DataFrame:
    """K5: random permutation with a seed, as a dense rank column (0-based). The rows are written before they are ranked:
    a range exchange reads its input twice, once for its bounds."""
    keyed = write_once(df.withColumn("_pf_h", seeded_order_key(key_cols, seed)), "shuffle-keys")
    ranked = with_global_rank(keyed, ["_pf_h", *key_cols], name, num_partitions)
    return ranked.drop("_pf_h")


def first_n_per_group(df: DataFrame, group: Sequence[str] | None, order: Sequence, n: int) -> DataFrame:
    """K1/K2/K4: the first ``n`` rows in ``order``, per group (or overall when group is None).

    With a group, ``row_number <= n`` lets Spark insert a partial WindowGroupLimit before the
    shuffle, so each group sends at most ``n`` rows per map task.
    """
    if not group:
        return df.orderBy(*_cols(order)).limit(n)
    w = Window.partitionBy(*group).orderBy(*_cols(order))
    return df.withColumn("_pf_rn", F.row_number().over(w)).filter(F.col("_pf_rn") <= n).drop("_pf_rn")


def cut_before_rank(df: DataFrame, group: Sequence[str], order: str, n) -> DataFrame:
    """Drop rows that cannot be among the first ``n`` of their group by ``order`` (a position).

    A plain top-n sends up to n rows from every task to one. Here rows are first counted per group and
    bit length of their distance from the group's first position (a partial aggregate with at most 64 rows
    per group), which gives each group a power of two below which at least n rows lie; only rows below it
    are ranked afterwards. That is no more than the rows between the half and the whole of that bound
    beyond n, whatever the number of tasks and wherever the group begins. The positions are written once
    for both aggregates. ``n`` is a number, or a Column of the group columns."""
    place = F.greatest(F.col(order).cast("long"), F.lit(0).cast("long"))

    def bits(first):
        return F.length(F.bin(place - first))

    n = F.lit(n) if isinstance(n, int) else n
    places = write_once(df.select(*group, order), "positions")
    firsts = F.broadcast(places.groupBy(*group).agg(F.min(place).alias("_pf_first")))  # one row a group
    met = places.join(firsts, list(group)) if group else places.crossJoin(firsts)
    counts = met.groupBy(*group, "_pf_first", bits(F.col("_pf_first")).alias("_pf_b")).agg(F.count(F.lit(1)).alias("_pf_c"))
    before = Window.partitionBy(*group).orderBy("_pf_b").rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.withColumn("_pf_s", F.coalesce(F.sum("_pf_c").over(before), F.lit(0))).filter(F.col("_pf_s") < n)
    cuts = needed.groupBy(*group).agg(F.max("_pf_b").alias("_pf_cut"), F.min("_pf_first").alias("_pf_first"))
    # Groups are few (sources, splits): a shuffle by them would take each whole to one task.
    met = df.join(F.broadcast(cuts), list(group)) if group else df.crossJoin(F.broadcast(cuts))
    return met.filter(bits(F.col("_pf_first")) <= F.col("_pf_cut")).drop("_pf_cut", "_pf_first")


def split_by_counts(ranked: DataFrame, rank_col: str, counts: Sequence[tuple[str, int]],
                    split_col: str = "split") -> DataFrame:
    """K7: cut a ranked table at absolute positions, e.g. [("train", 5000), ("validation", 500), ...].

    Rows beyond the last bound are dropped, as ``select(range(a, b))`` would; the caller checks
    the total first if too few rows must raise.
    """
    expr = None
    lo = 0
    for name, cnt in counts:
        cond = (F.col(rank_col) >= lo) & (F.col(rank_col) < lo + cnt)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
        lo += cnt
    return ranked.withColumn(split_col, expr).filter(F.col(split_col).isNotNull())


def split_by_ratio(ranked: DataFrame, rank_col: str, total: Column, ratios: Sequence[tuple[str, float]],
                   rest: str = "test", split_col: str = "split") -> DataFrame:
    """K8: ``int(n*r)`` rows per named ratio in order, the rest to ``rest``.

    ``total`` is a Column holding n (e.g. a scalar subquery), so no driver round trip is needed.
    Ratios are double literals (a bare decimal literal would be DECIMAL in Spark).
    """
    bound = F.lit(0).cast("long")
    expr = None
    for name, r in ratios:
        upper = bound + F.floor(total.cast("double") * F.lit(float(r))).cast("long")
        cond = (F.col(rank_col) >= bound) & (F.col(rank_col) < upper)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
        bound = upper
    expr = expr.otherwise(F.lit(rest)) if expr is not None else F.lit(rest)
    return ranked.withColumn(split_col, expr)
