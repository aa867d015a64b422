import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from paraforge.operators.ranking import (seeded_shuffle, split_by_counts, split_by_ratio,
                                         with_global_rank, with_rank_in_group)


def test_global_rank_dense_and_partition_invariant(spark):
    base = spark.range(0, 5000).select(((F.col("id") * 7919) % 10007).alias("k"), F.col("id"))
    expect = {r.id: r.rn for r in base.select("id", (F.row_number().over(Window.orderBy("k", "id")) - 1).alias("rn")).collect()}
    for parts in (1, 3, 11):
        got = {r.id: r.g for r in with_global_rank(base.repartition(parts), ["k", "id"], "g", num_partitions=parts + 2).collect()}
        assert got == expect


def test_rank_in_group_with_hot_group(spark):
    # one group holds most rows: positions must still be dense 0..n-1 inside every group
    df = spark.range(0, 3000).select(F.when(F.col("id") % 10 < 7, F.lit(0)).otherwise(F.col("id") % 5).alias("g"),
                                     F.col("id"))
    out = with_rank_in_group(df, ["g"], ["id"], "pos").groupBy("g").agg(
        F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"),
        F.countDistinct("pos").alias("d")).collect()
    for r in out:
        assert r.lo == 0 and r.hi == r.n - 1 and r.d == r.n


def test_seeded_shuffle_is_a_permutation_and_reproducible(spark):
    df = spark.range(0, 500).withColumnRenamed("id", "ord")
    a = {r.ord: r.r for r in seeded_shuffle(df, ["ord"], 42, "r").collect()}
    b = {r.ord: r.r for r in seeded_shuffle(df.repartition(7), ["ord"], 42, "r").collect()}
    assert a == b and sorted(a.values()) == list(range(500))
    c = {r.ord: r.r for r in seeded_shuffle(df, ["ord"], 7, "r").collect()}
    assert c != a


@pytest.mark.parametrize("n", [0, 7, 1001])
def test_split_by_ratio_sizes(spark, n):
    df = spark.range(0, n).withColumnRenamed("id", "r")
    total = df.select(F.count(F.lit(1))).scalar()
    got = {r.split: r.c for r in split_by_ratio(df, "r", total, [("train", 0.85), ("validation", 0.075)])
           .groupBy("split").agg(F.count("*").alias("c")).collect()}
    train, val = int(n * 0.85), int(n * 0.075)
    assert got.get("train", 0) == train and got.get("validation", 0) == val
    assert got.get("test", 0) == n - train - val


def test_split_by_counts(spark):
    df = spark.range(0, 10).withColumnRenamed("id", "r")
    got = {r.split: r.c for r in split_by_counts(df, "r", [("train", 6), ("validation", 2), ("test", 5)])
           .groupBy("split").agg(F.count("*").alias("c")).collect()}
    assert got == {"train": 6, "validation": 2, "test": 2}


def test_running_sum_matches_cumsum(spark):
    from paraforge.operators.ranking import with_running_sum
    rows = [(0 if i % 10 < 7 else i % 4, i, (i * 37) % 11) for i in range(2000)]   # group 0 is hot
    df = spark.createDataFrame(rows, "g long, t long, v long")
    got = {(r.g, r.t): r.off for r in with_running_sum(df, ["g", "t"], "v", "off", num_partitions=5).collect()}
    acc, want = 0, {}
    for g, t, v in sorted(rows):
        want[(g, t)] = acc
        acc += v
    assert got == want


def test_pair_offsets_closed_form(spark):
    from paraforge.sources.fixtures import FOLLOWERS, _pairs_before, _pairs_total
    rows = [(n, p) for n in range(0, 25) for p in range(0, max(n, 1))]
    df = spark.createDataFrame(rows, "n long, p long")
    out = df.select("n", "p", _pairs_before(F.col("p"), F.col("n")).alias("b"), _pairs_total(F.col("n")).alias("t")).collect()
    for r in out:
        assert r.b == sum(min(FOLLOWERS, r.n - 1 - q) for q in range(r.p))
        assert r.t == sum(min(FOLLOWERS, j) for j in range(r.n))


@pytest.mark.parametrize("n", [1, 4, 2000])
def test_index_quantiles_rule(spark, n):
    from paraforge.operators.profile import index_quantiles
    vals = [((i * 7919) % 97) / 97.0 for i in range(n)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "ord long, overlap double")
    r = index_quantiles(df).first()
    s = sorted(vals)
    assert (r.n, r.min, r.q1, r.median, r.q3, r.max) == (n, s[0], s[n // 4], s[n // 2], s[3 * n // 4], s[-1])


def test_cut_before_rank_counts_from_the_first_of_a_group(spark):
    from paraforge.operators.ranking import cut_before_rank
    # a split that begins far from 0: its positions all have the same bit length
    df = spark.range(0, 40_000).select(F.when(F.col("id") < 33_000, "train").otherwise("test").alias("split"), F.col("id").alias("ord"))
    cut = cut_before_rank(df, ["split"], "ord", 100)
    got = {r.split: (r.n, r.lo) for r in cut.groupBy("split").agg(F.count("*").alias("n"), F.min("ord").alias("lo")).collect()}
    assert got["train"][1] == 0 and got["test"][1] == 33_000
    assert all(100 <= n <= 300 for n, _ in got.values())
    plan = cut._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan  # no shuffle by the split
    every = cut_before_rank(df, [], "ord", 100)
    assert 100 <= every.count() <= 300 and cut_before_rank(df.limit(0), [], "ord", 5).count() == 0


def test_stage_counts_and_shuffle_score_their_rows_once(spark):
    from paraforge.operators.pairs import build_stage_counts
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    schema = "ord long, question1 string, question2 string, label int"
    pairs = spark.createDataFrame([(i, "a b c d", "a x y z" if i % 2 else "q r s t", 1) for i in range(40)], schema).mapInPandas(told, schema)
    lists = spark.createDataFrame([(0, "a b c d", '["a x y z"]', "sentence")], "ord long, text string, paraphrases string, category string")
    got = {r.stage: r.num_rows for r in build_stage_counts(pairs, lists, 5, 0.1, 0.5).collect()}
    assert got == {"question_positives": 40, "question_in_band": 20, "question_capped": 5, "declarative_rows": 1, "declarative_in_band": 1,
                   "declarative_capped": 1}
    assert seen.value == 40
    seeded_shuffle(pairs, ["ord"]).collect()
    assert seen.value == 80
