"""Groups of any size compared in bounded blocks: each group is dealt to blocks by a hash, and each
pair of blocks is one small unit of work, so that no task ever holds a whole group."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_pairs(rows: DataFrame, n_blocks: Column, salt: Column) -> DataFrame:
    """Add ``bi``, ``bj`` (bi <= bj) and ``side`` (1: the row is of block bi, 2: of block bj, 3: both
    are one); a row comes once for each block pair that its block is in."""
    dealt = rows.withColumn("_n", n_blocks.cast("int")).withColumn("_b", F.pmod(salt, F.col("_n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_o")
    return (dealt.select("*", other)
            .withColumn("bi", F.least("_b", "_o")).withColumn("bj", F.greatest("_b", "_o"))
            .withColumn("side", F.when(F.col("_b") == F.col("_o"), 3).when(F.col("_b") == F.col("bi"), 1).otherwise(2))
            .drop("_n", "_b", "_o"))


def each_group(batches, n_keys: int):
    """Tables of the rows of one key (the first ``n_keys`` columns) from batches sorted by key; a
    group may run over several batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys))))
        at = 0
        while at < len(keys):
            end = at
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if held and last != keys[at]:
                yield last, pa.Table.from_batches(held)
                held = []
            last = keys[at]
            held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield last, pa.Table.from_batches(held)
