"""B5 mine_cluster_pairs: clusters -> in-cluster pairs in an overlap band -> counts + preview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraforge.operators.ranking import seeded_order_key
from paraforge.operators.simjoin import band_pairs, band_pairs_in_rows

# Reference defaults for training-pair mining (both ends inclusive).
BAND_LO = 0.15
BAND_HI = 0.45


def mine_cluster_pairs(clusters: DataFrame, lo: float = BAND_LO, hi: float = BAND_HI) -> DataFrame:
    """J1 -> F2 -> P7: (cluster_id, pos1, pos2, sentence1, sentence2, overlap)."""
    return band_pairs(clusters, "cluster_id", "pos", "sentence", lo, hi)


def mine_row_pairs(rows: DataFrame, lo: float = BAND_LO, hi: float = BAND_HI) -> DataFrame:
    """The same for clusters that are one row each (cluster_id, sentences): no shuffle."""
    return band_pairs_in_rows(rows, "cluster_id", "sentences", lo, hi)


def group_clusters(clusters: DataFrame) -> DataFrame:
    """A5: per-cluster size and position range. The sentences stay in long form (cluster_id,
    pos, sentence); a cluster is never collected into one row."""
    return clusters.groupBy("cluster_id").agg(
        F.count(F.lit(1)).cast("long").alias("n_sentences"),
        F.min("pos").cast("long").alias("first_pos"),
        F.max("pos").cast("long").alias("last_pos"))


def mining_counts(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """A2 for B5: clusters, clusters with >= 2 sentences, and in-band pairs, as (stage, num_rows)."""
    sizes = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))

    def stage(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).cast("long").alias("num_rows")).select(F.lit(name).alias("stage"), "num_rows")

    return (stage(sizes, "clusters")
            .unionByName(stage(sizes.filter(F.col("n") >= 2), "clusters_with_pairs"))
            .unionByName(stage(pairs, "pairs_in_band")))


def random_preview(pairs: DataFrame, key_cols, k: int = 15, seed: int | str = 42) -> DataFrame:
    """K6: k pairs in a seeded pseudo-random order (top-k on an md5 key: one partial top-k per
    task, no global sort)."""
    keyed = pairs.withColumn("_pf_h", seeded_order_key(key_cols, seed))
    return keyed.orderBy("_pf_h", *key_cols).limit(k).drop("_pf_h")
