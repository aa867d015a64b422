"""URL filter: host and path rules first, else a character language-model ratio.

URLs that a rule accepts or rejects train two variable-order Markov models over the bytes of host and
path: p(byte | last m bytes) = (n(context, byte) + ``PRIOR`` * p(byte | last m - 1 bytes)) / (n(context) + ``PRIOR``),
from order ``ORDER`` down to a uniform share. The counts are exact and stay a Spark table, keyed by order, context and
byte packed into one number, with a column for each class and fold. A URL that no rule fits is judged by the
difference of both log-likelihoods divided by its length: the distinct grams of all such URLs look up their counts in one join, and
each URL sums the differences of its grams. Only the threshold reaches the driver.

The threshold is calibrated: a first pair of models leaves out every ``FOLDS``-th URL by hash, and the threshold is the one
with the least balanced error on those; the final models count all URLs.

Null URLs and URLs without ``://`` have an empty host and path, fit no rule and are judged as empty strings
(score of the end marker alone). Without URLs of both classes the threshold is 0. Repeated rows count again and
are judged one by one; columns beside page_id and url are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paraforge.llm.common import join_hot, stored, table
from paraforge.llm.words import slices

# The rules of the contract (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
ORDER = 4
PRIOR = 4.0
FOLDS = 5
BINS = 2000
SPAN = 4.0  # scores are binned between -SPAN and SPAN nats a byte
# Symbols: the end marker, a byte + 1, the place before the start, and the mark of a context's own count.
END, BEFORE, ANY = 0, 300, 511
BITS = 9


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict (both null if none does)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At every byte of each string and its end marker: the gram (the last ``ORDER`` symbols and the symbol, ``BITS`` bits
    each, the nearest lowest but the symbol itself) and the row. Contexts do not reach over the start of a string."""
    n = np.diff(off)
    size = n + 1
    start = np.concatenate([[0], np.cumsum(size)])
    text = np.full(start[-1], END, dtype=np.int64)
    row = np.repeat(np.arange(len(n)), size)
    inside = np.arange(start[-1]) - start[:-1][row]
    body = inside < n[row]
    text[body] = data.astype(np.int64) + 1
    gram = text.copy()
    for back in range(1, ORDER + 1):
        before = np.full(start[-1], BEFORE, dtype=np.int64)
        before[back:] = np.where(inside[back:] >= back, text[:-back], BEFORE)
        gram |= before << (BITS * back)
    return gram, row


def _key(gram, order: int, context: bool):
    """The table's key of a gram at one order, or of its context; works on numbers, arrays and columns alike."""
    if isinstance(gram, Column):
        low = gram.bitwiseAND(F.lit((1 << (BITS * (order + 1))) - 1))
        own = low.bitwiseOR(F.lit(ANY)) if context else low
        return own.bitwiseOR(F.lit(order << (BITS * (ORDER + 1))))
    low = gram & ((1 << (BITS * (order + 1))) - 1)
    return (low | ANY if context else low) | order << (BITS * (ORDER + 1))


def _count(batches):
    """mapInArrow over (string, kind, n): (key, kind, n) summed within a slice of the batch."""
    for batch in batches:
        kinds, times = np.asarray(batch.column(1)).astype(np.int64), np.asarray(batch.column(2))
        for at, data, off in slices(batch.column(0)):
            gram, row = _grams(data, off)
            for kind in range(4):
                mine = kinds[at + row] == kind
                for order in range(ORDER + 1):
                    for context in (False, True):
                        key, place = np.unique(_key(gram[mine], order, context), return_inverse=True)
                        count = np.bincount(place, times[at + row[mine]], len(key)).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), kind, np.int32)), pa.array(count)],
                                                         names=["key", "kind", "n"])


def count_table(labelled: DataFrame) -> DataFrame:
    """(key, n0 .. n3) over all labelled URLs (s, class, fold, n): rejected and accepted ones outside the held-out fold, then
    those in it."""
    rows = labelled.select("s", (F.col("fold") * 2 + F.col("class")).alias("kind"), "n").mapInArrow(_count, "key long, kind int, n long")
    return stored(rows.groupBy("key").agg(*[
        F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(4)]), "url-counts")


def _places(batches):
    """mapInArrow over (string, id): (id, gram, times) of each string."""
    for batch in batches:
        ids = np.asarray(batch.column(1))
        for at, data, off in slices(batch.column(0)):
            gram, row = _grams(data, off)
            order = np.lexsort((gram, row))
            gram, row = gram[order], row[order]
            new = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])])) if len(gram) else np.zeros(0, int)
            times = np.diff(np.append(new, len(gram)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at + row[new]]), pa.array(gram[new]), pa.array(times.astype(np.int64))],
                                             names=["id", "gram", "times"])


def gram_ratios(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, trained, final): log p(accepted) - log p(rejected) of each distinct gram, without the held-out fold and with it."""
    slots = [(order, context) for order in range(ORDER + 1) for context in (False, True)]
    wanted = stored(grams.select("gram", F.posexplode(F.array(*[_key(F.col("gram"), *slot) for slot in slots])).alias("slot", "key")), "url-wanted")
    # A low order's key belongs to very many grams; each key's number of rows is counted to join the common ones by broadcast.
    weights = wanted.groupBy("key").agg(F.count(F.lit(1)).alias("weight"))
    found = join_hot(wanted, stored(counts.join(weights, "key"), "url-known"), ["key"], "weight", wanted.count())
    per_gram = found.groupBy("gram").agg(*[
        F.coalesce(F.max(F.when(F.col("slot") == i, F.col(f"n{k}"))), F.lit(0)).alias(f"c{i}_{k}") for i in range(len(slots)) for k in range(4)])

    def log_p(kinds) -> Column:
        p = F.lit(1 / 257)
        for order in range(ORDER + 1):
            seen, base = (sum((F.coalesce(F.col(f"c{2 * order + what}_{k}"), F.lit(0)) for k in kinds), F.lit(0)) for what in (0, 1))
            p = (seen + PRIOR * p) / (base + PRIOR)
        return F.log(p)

    every = grams.join(per_gram, "gram", "left")
    return every.select("gram", (log_p([1]) - log_p([0])).alias("trained"), (log_p([1, 3]) - log_p([0, 2])).alias("final"))


def scored_strings(strings: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, trained, final): length-normalised log-likelihood differences of (s, id)."""
    places = stored(strings.select("s", "id").mapInArrow(_places, "id long, gram long, times long"), "url-places")
    grams = stored(places.groupBy("gram").agg(F.count(F.lit(1)).alias("weight")), "url-grams")
    ratios = stored(gram_ratios(grams.select("gram"), counts).join(grams, "gram"), "url-ratios")
    met = join_hot(places, ratios, ["gram"], "weight", places.count())
    length = F.sum("times")
    return met.groupBy("id").agg(*[(F.sum(F.col(c) * F.col("times")) / length).alias(c) for c in ("trained", "final")])


def calibrate(scored: DataFrame) -> float:
    """The threshold of least balanced error on held-out URLs (class, score, n), from a histogram of fixed bins."""
    place = F.floor((F.least(F.greatest("score", F.lit(-SPAN)), F.lit(SPAN - 1e-9)) + SPAN) * (BINS / (2 * SPAN)))
    rows = scored.groupBy("class", place.cast("int").alias("bin")).agg(F.sum("n").alias("n")).collect()
    histogram = np.zeros((2, BINS))
    for r in rows:
        histogram[r["class"], r["bin"]] += r["n"]
    totals = histogram.sum(axis=1)
    if not totals.all():
        return 0.0
    # accepted below the threshold and rejected at or above it
    wrong = (np.concatenate([[0], np.cumsum(histogram[1])]) / totals[1]
             + 1 - np.concatenate([[0], np.cumsum(histogram[0])]) / totals[0])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float(best[len(best) // 2] * (2 * SPAN / BINS) - SPAN)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of ``pages`` (page_id, url); the score is
    null where a rule decided."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = stored(parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"),
                                F.concat("host", "path").alias("s")), "url-parts")
    # Distinct strings, as repeated urls have one score. A rule depends on host and path, so a string might have several.
    strings = ruled.groupBy("s", "rule", "by_rule").agg(F.count(F.lit(1)).alias("n"))
    strings = stored(strings.withColumn("id", F.monotonically_increasing_id()), "url-strings")
    labelled = strings.filter("rule IS NOT NULL").select(
        "s", "id", "n", (F.col("by_rule") == "allow").cast("int").alias("class"),
        (F.pmod(F.xxhash64("s"), F.lit(FOLDS)) == 0).cast("int").alias("fold"))
    counts = count_table(labelled)
    held = labelled.filter("fold = 1")
    scores = stored(scored_strings(strings.filter("rule IS NULL").select("s", "id").unionByName(held.select("s", "id")), counts), "url-scores")
    threshold = calibrate(held.join(scores, "id").select("class", F.col("trained").alias("score"), "n"))
    unruled = ruled.filter("rule IS NULL")
    open_scores = stored(strings.filter("rule IS NULL").join(scores, "id").select("s", F.col("final").alias("score"), "n"), "url-open")
    left = join_hot(unruled, open_scores, ["s"], "n", unruled.count()).select("page_id", "host", "path", "rule",
        F.when(F.col("score") >= threshold, "allow").otherwise("block").alias("verdict"), "score")
    return ruled.filter("rule IS NOT NULL").select("page_id", "host", "path", "rule", F.col("by_rule").alias("verdict"),
                                                   F.lit(None).cast("double").alias("score")).unionByName(left)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page url."""
    return judge(table(spark, sf_dir, "pages", "page_id", "url"))
