"""Sources and sinks (S1-S4, S6-S8). Every reader takes an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraforge import schemas
from paraforge.operators.ranking import with_rank_in_group


def read_supplied(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied Parquet tables, read with its declared schema."""
    return spark.read.schema(schemas.SUPPLIED[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread rows by ``key`` before per-row text work, always: input files may be few and large,
    or one text table may lie in a few row groups. Adaptive execution picks the partition count from the
    shuffled size, and readers of one spread table share its exchange."""
    return df.repartition(key)


def _read(spark: SparkSession, path: str, schema, fmt: str) -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt in ("csv", "json"):
        reader = reader.option("mode", "FAILFAST")
    if fmt == "csv":
        reader = reader.option("header", "true").option("multiLine", "true").option("escape", '"')
    return reader.format(fmt).load(path)


def scan_labelled_pairs(spark: SparkSession, path: str, split: str | None = None,
                        fmt: str = "parquet", schema=None) -> DataFrame:
    """A labelled pair table, optionally one split of it. The default shape is question pairs (with a
    ``split`` column if one is asked for); pass ``schemas.SENTENCE_PAIRS`` for sentence pairs. The split
    filter reaches the scan. Malformed CSV or JSON rows raise."""
    if schema is None:
        schema = schemas.LABELLED_PAIRS if split is None else schemas.LABELLED_PAIRS_BY_SPLIT
    df = _read(spark, path, schema, fmt)
    return df.filter(F.col("split") == split) if split is not None else df


def scan_paraphrase_lists(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Text, paraphrases (list literal), category, source."""
    return _read(spark, path, schemas.PARAPHRASE_LISTS, fmt)


def scan_clusters(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S3: (cluster_id, pos, sentence)."""
    return _read(spark, path, schemas.CLUSTERS, fmt)


def scan_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One sentence per line, with the line's 0-based position in its file.

    The position comes from the file path, the split's byte offset and the row order inside the
    split, ranked per file without a single-partition Window.
    """
    raw = (spark.read.text(path)
           .select(F.col("value").alias("sentence"),
                   F.col("_metadata.file_path").alias("file"),
                   F.col("_metadata.file_block_start").alias("_pf_block"),
                   F.monotonically_increasing_id().alias("_pf_row")))
    out = with_rank_in_group(raw, ["file"], ["_pf_block", "_pf_row"], "line_no")
    return out.select("file", "line_no", "sentence")


def write_splits(df: DataFrame, path: str, split_col: str = "split", mode: str = "overwrite") -> str:
    """Persist a split set as Parquet, one folder per split."""
    df.write.mode(mode).partitionBy(split_col).parquet(path)
    return path


def read_splits(spark: SparkSession, path: str, split: str | None = None, schema=None) -> DataFrame:
    """Load a saved split set; a split filter prunes folders (PartitionFilters)."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    return df.filter(F.col("split") == split) if split is not None else df


def table_profile(df: DataFrame, split_col: str | None = "split") -> DataFrame:
    """Rows per split (one aggregate job) plus the column list, as one small table."""
    cols = ",".join(df.columns)
    if split_col and split_col in df.columns:
        agg = df.groupBy(split_col).agg(F.count(F.lit(1)).alias("num_rows"))
    else:
        agg = df.agg(F.count(F.lit(1)).alias("num_rows")).withColumn(split_col or "split", F.lit("all"))
    return agg.select(F.col(split_col or "split").alias("split"), "num_rows",
                      F.lit(len(df.columns)).alias("num_columns"), F.lit(cols).alias("columns"))
