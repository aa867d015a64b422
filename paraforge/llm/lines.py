"""Line dedup with levelled sorted runs of line keys.

A line's key is the line without white space (U+0009-U+000D, space) at both ends, with A-Z lower-cased; keys
shorter than ``MIN_CHARS`` code points are left alone. ``LineRuns`` keeps what is known about keys in runs: tables
bucketed by the 128-bit hash of the key and sorted by it inside each bucket, with the number of documents that hold the key and
the greatest doc_id among them. Batches of documents come in descending doc_id order, so the first batch that holds a key holds
its greatest doc_id. Each new batch

1. counts its own keys (partial aggregates first, so that a very common line is one row per map task),
2. is merge-anti-joined with the settled keys of every run: keys known from ``min_docs`` documents are decided, and no
   later batch changes them,
3. adds the rest as a run of level 0. Two runs of one level are compacted by a merge join into one of the next, so there
   are at most log2(batches) runs, and a key is rewritten at most as often. Runs share their buckets: neither the anti-joins
   nor the compactions shuffle a run.

At the end the compacted runs hold the keys of at least ``min_docs`` documents and the one document each that keeps its lines.
The keys of all documents are joined with them (very common keys by broadcast, at most ``HOT_KEYS`` of them), and
each text loses its lines in one Arrow pass; texts that lose nothing never leave the JVM.

Documents are rows. Null and empty texts are one empty line. Null ids are the smallest id: rows with a null id share it. Repeated rows
count as documents of their own and, where their id is the greatest, all keep the line. Columns beside doc_id and
text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraforge.llm.common import LOWER, UPPER, join_hot, stored, table
from paraforge.session import scratch_path

# Fixed values of the contract.
BLANK = " \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3
# Fixed value: the seed of Spark's xxhash64.
SEED = 42

BATCHES = 4


def _keys(text, min_chars: int):
    """The distinct keys of a text that are long enough."""
    lines = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "\n")
    return F.array_distinct(F.filter(F.transform(lines, lambda x: F.btrim(x, F.lit(BLANK))),
                                     lambda x: F.length(x) >= min_chars))


def document_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, r1, r2, h1, h2): one row per document and distinct key; r names the row, h the key."""
    full = F.coalesce(F.col("text"), F.lit(""))
    no_id = F.isnull("doc_id")
    rows = docs.select("doc_id", F.xxhash64(no_id, "doc_id", full).alias("r1"),
                       F.xxhash64(F.lit(7), no_id, "doc_id", full).alias("r2"),
                       F.explode(_keys(F.col("text"), min_chars)).alias("key"))
    return rows.select("doc_id", "r1", "r2", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


class LineRuns:
    """Levelled sorted runs of (h1, h2, n, holder); level i holds at most one run, of 2**i batches."""

    KEY = ["h1", "h2"]

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS):
        self.spark, self.min_docs = spark, min_docs
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[DataFrame | None] = []

    def runs(self) -> list[DataFrame]:
        return [run for run in self.levels if run is not None]

    def _write(self, rows: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex[:12]}"
        (rows.write.bucketBy(self.buckets, *self.KEY).sortBy(*self.KEY)
         .option("path", scratch_path(self.spark, name)).saveAsTable(name))
        return self.spark.table(name)

    def add(self, batch: DataFrame) -> None:
        """Add the keys (h1, h2, n, holder; one row each) of a batch whose ids are all below those added before."""
        batch = batch.repartition(self.buckets, *self.KEY)
        for run in self.runs():
            batch = batch.join(run.filter(F.col("n") >= self.min_docs).hint("merge"), self.KEY, "left_anti")
        run, level = self._write(batch), 0
        while level < len(self.levels) and self.levels[level] is not None:
            run, self.levels[level] = self._merge(self.levels[level], run), None
            level += 1
        self.levels[level:level + 1] = [run]

    def _merge(self, old: DataFrame, new: DataFrame) -> DataFrame:
        a, b = old.alias("a"), new.hint("merge").alias("b")
        both = a.join(b, (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")), "full")
        return self._write(both.select(
            *[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in self.KEY],
            (F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).alias("n"),
            F.greatest("a.holder", "b.holder").alias("holder")).repartition(self.buckets, *self.KEY))

    def compacted(self) -> DataFrame:
        """All that is known, as one run."""
        while len(self.runs()) > 1:
            least, second = [i for i, run in enumerate(self.levels) if run is not None][:2]
            self.levels[second] = self._merge(self.levels[second], self.levels[least])
            self.levels[least] = None
        return self.runs()[0]


def _batch_of(docs: DataFrame, batches: int):
    """Batch 0 holds the greatest ids; the bounds are approximate quantiles, and any bounds give the same result."""
    shares = [i / batches for i in range(1, batches)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, 200)).first()[0] if shares else None
    bounds = sorted(set(bounds or ()), reverse=True)
    batch = F.lit(0)
    for bound in bounds:
        batch = batch + F.when(F.coalesce(F.col("doc_id") <= bound, F.lit(True)), 1).otherwise(0)
    return batch, len(bounds) + 1


def repeated_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> tuple:
    """(h1, h2, n, holder) of the keys that at least ``min_docs`` documents hold, and the number of all
    (document, key) pairs. ``n`` is exact for undecided keys and at least ``min_docs`` for the others."""
    batch, n_batches = _batch_of(docs, batches)
    own = document_keys(docs.select("doc_id", "text"), min_chars).withColumn("batch", batch.cast("int")).groupBy(
        "batch", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("holder"))
    path = scratch_path(docs.sparkSession, "line-batches")
    own.write.partitionBy("batch").parquet(path)
    own = docs.sparkSession.read.schema(own.schema).parquet(path)
    runs = LineRuns(docs.sparkSession, min_docs)
    for i in range(n_batches):
        runs.add(own.filter(F.col("batch") == i).drop("batch"))
    known = runs.compacted().filter(F.col("n") >= min_docs)
    weights = own.groupBy("h1", "h2").agg(F.sum("n").alias("weight"))
    total = own.agg(F.sum("n")).first()[0] or 0
    return stored(known.join(weights, ["h1", "h2"]), "line-repeats"), total


def _drop_lines(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
    """Drop the lines whose keys are in ``gone`` (first halves of their hashes, then second halves)."""
    second = xxhash.xxh64_intdigest((7).to_bytes(4, "little"), SEED)
    out = []
    for t, g in zip(text, gone):
        if g is None or t is None:
            out.append((0, None))
            continue
        n = len(g) // 2
        dead = set(zip((int(x) % 2 ** 64 for x in g[:n]), (int(x) % 2 ** 64 for x in g[n:])))
        lines, kept = t.encode().split(b"\n"), []
        for line in lines:
            key = line.strip(BLANK.encode()).lower()
            if (xxhash.xxh64_intdigest(key, SEED), xxhash.xxh64_intdigest(key, second)) not in dead:
                kept.append(line)
        out.append((len(lines) - len(kept), b"\n".join(kept).decode()))
    return pd.DataFrame(out, columns=["n_dropped", "kept_text"])


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                        batches: int = BATCHES) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, kept_text) for every row of ``docs``: lines whose key is at least
    ``min_chars`` long and in at least ``min_docs`` documents stay only in the greatest doc_id that holds it."""
    docs = docs.select("doc_id", "text")
    repeats, total = repeated_keys(docs, min_chars, min_docs, batches)
    hits = join_hot(document_keys(docs, min_chars), repeats.drop("n"), ["h1", "h2"], "weight", total)
    gone = (hits.filter(~F.col("doc_id").eqNullSafe(F.col("holder"))).groupBy("r1", "r2")
            .agg(F.collect_set(F.struct("h1", "h2")).alias("keys"))
            .select("r1", "r2", F.concat("keys.h1", "keys.h2").alias("gone")))
    full = F.coalesce(F.col("text"), F.lit(""))
    no_id = F.isnull("doc_id")
    keyed = docs.withColumns({"r1": F.xxhash64(no_id, "doc_id", full), "r2": F.xxhash64(F.lit(7), no_id, "doc_id", full)})
    rows = keyed.join(stored(gone, "line-gone"), ["r1", "r2"], "left")
    touched = F.col("gone").isNotNull()
    drop_lines = F.pandas_udf(_drop_lines, "struct<n_dropped:long,kept_text:string>")
    cut = rows.withColumn("cut", drop_lines(F.when(touched, F.col("text")), F.col("gone")))
    breaks = F.length(full) - F.length(F.replace(full, F.lit("\n"), F.lit("")))
    return cut.select("doc_id", "text", (breaks + 1).cast("long").alias("n_lines"),
                      F.coalesce("cut.n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
                      F.when(touched, F.col("cut.kept_text")).otherwise(full).alias("kept_text"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    rows = drop_repeated_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
