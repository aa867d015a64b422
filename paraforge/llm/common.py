"""Reading the given tables, and materialising intermediate ones in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraforge.session import scratch_path

# Fixed value: the word pattern of the contracts (space and U+0009-U+000D separate words).
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOT_KEYS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one given table; other columns never reach the scan."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back: lineage ends there,
    so a lost executor costs a reread and not a recomputation."""
    path = scratch_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as set it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_key(text) -> list:
    """A 128-bit key of a text as two longs (null counts as empty), so that repeated rows of a
    text, and rows with null or repeated ids, need no row number."""
    full = F.coalesce(text, F.lit(""))
    return [F.xxhash64(full).alias("k1"), F.xxhash64(F.lit(7), full).alias("k2")]


def join_hot(rows: DataFrame, side: DataFrame, on: list, weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``side``, which has one row per key and in ``weight`` the number of
    rows that have the key (``total`` in all). Keys with at least 1 / ``HOT_KEYS`` of all rows are at most
    ``HOT_KEYS``, so their side is broadcast; for the others Spark chooses, and none of them is hot."""
    least = max(1, -(-total // HOT_KEYS))
    hot, rest = side.filter(F.col(weight) >= least), side.filter(F.col(weight) < least)
    names = [*rows.columns, *(c for c in side.columns if c not in on)]
    cold_rows = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return (rows.join(F.broadcast(hot), on).select(*names)
            .unionByName(cold_rows.join(rest, on).select(*names)))
