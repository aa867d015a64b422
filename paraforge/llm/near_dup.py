"""Near-duplicate documents by HyperMinHash registers, exact on the final decision.

1. Every whole text becomes its set of distinct 5-word shingles (64-bit hashes) and ``REGISTERS``
   HyperMinHash registers. A register is the least hash under one of as many multiplicative
   permutations, kept as its number of leading zeros (6 bits) and 10 mantissa bits. Each register has
   its own permutation instead of a bucket of one, so that short documents have no empty buckets.
2. Equal sets are one class (128-bit digest, then a number of its own); only classes go on.
3. Bands of 4 registers are buckets. A pair of sets with similarity 0.75 shares none of the 36 bands
   with probability 1e-6. Buckets with one class end here.
4. In a bucket, pairs are compared by registers: the share of equal registers, corrected for chance
   collisions, must reach ``ESTIMATE`` (4.7 standard errors below 0.75). The components of the likely pairs are
   *clusters*; every true link lies within one.
5. Within clusters pairs of classes are confirmed on the full sets: 100 * intersection >= 75 * union. Components of
   confirmed links give the result.

Buckets and clusters of any size are compared by ``connect`` in blocks of bounded size: inside blocks first, then one row a
component, and across blocks only what is not connected by then.

Texts are identified by hashes, so null or repeated ids and repeated rows are fine; null, empty and
blank texts have empty sets and are linked with nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paraforge.llm.blocks import each_group
from paraforge.llm.common import stored, table, text_key, unused
from paraforge.llm.graph import Forest, components
from paraforge.llm.words import U64, as_signed, lower_ascii, mix, slices, window_hashes, word_hashes, word_spans

SHINGLE = 5
REGISTERS, BAND = 144, 4
MANTISSA = 10
ESTIMATE = 0.58
BLOCK = 256
BLOCK_SHINGLES = 1 << 20
# Fixed value of the estimator: chance collisions of two registers of sets of like size, times 2**r.
COLLISION = 0.1699


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a slice."""
    data = lower_ascii(data)
    starts, ends, first = word_spans(data, off)
    words = word_hashes(data, starts, ends)
    shingles = window_hashes(words, size)
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
        if z - a >= size:
            out.append(np.unique(shingles[a:z - size + 1]))
        else:
            out.append(window_hashes(words[a:z], z - a) if z > a else np.zeros(0, U64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 16-bit registers per nonempty set."""
    odd = mix(np.arange(1, REGISTERS + 1, dtype=U64) * U64(0xD1B54A32D192ED03)) | U64(1)
    every = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    least = np.empty((len(sets), REGISTERS), dtype=U64)
    for i, factor in enumerate(odd):
        least[:, i] = np.minimum.reduceat(every * factor, starts)
    fraction, exponent = np.frexp(least.astype(np.float64))
    zeros = np.minimum(64 - exponent, 63).astype(np.uint16)
    mantissa = ((fraction * 2 - 1).clip(0) * (1 << MANTISSA)).astype(np.uint16) & ((1 << MANTISSA) - 1)
    return (zeros << MANTISSA | mantissa).astype("<u2")


def estimate(equal: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard similarity from numbers of equal registers."""
    chance = COLLISION / (1 << MANTISSA)
    return (equal / REGISTERS - chance) / (1 - chance)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _sign(batches):
    """mapInArrow over (doc_id, k1, k2, text): set size, 128-bit set digest and registers."""
    for batch in batches:
        for at, data, off in slices(batch.column(3)):
            sets = shingle_sets(data, off)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            some = np.flatnonzero(n)
            regs = [None] * len(sets)
            digests = np.zeros((2, len(sets)), dtype=U64)
            if len(some):
                full = [sets[i] for i in some]
                starts = np.cumsum([0] + [len(s) for s in full[:-1]])
                every = np.concatenate(full)
                for k in (0, 1):
                    digests[k, some] = mix(np.add.reduceat(mix(every + U64(k * 977 + 1)), starts) + n[some].astype(U64))
                for i, r in zip(some.tolist(), registers(full)):
                    regs[i] = r.tobytes()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).slice(at, len(sets)) for i in range(3)), pa.array(n),
                 pa.array(as_signed(digests[0])), pa.array(as_signed(digests[1])), pa.array(regs, pa.binary())],
                names=["doc_id", "k1", "k2", "n", "d1", "d2", "regs"])


def _bands(batches):
    """mapInArrow over (cid, regs, n): one (bucket, cid, n) per band."""
    n = REGISTERS // BAND
    for batch in batches:
        if batch.num_rows == 0:
            continue
        regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u2").reshape(-1, REGISTERS)
        packed = np.ascontiguousarray(regs).view("<u8")
        bucket = mix(packed ^ mix(np.arange(1, n + 1, dtype=U64))[None, :])
        yield pa.RecordBatch.from_arrays(
            [pa.array(as_signed(bucket.ravel())), pa.array(np.repeat(np.asarray(batch.column(0)), n)),
             pa.array(np.repeat(np.asarray(batch.column(2)), n))], names=["grp", "cid", "n"])


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.asarray(table.column(c).combine_chunks()) for c in names]


def _regs(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("regs").to_pylist()), dtype="<u2").reshape(-1, REGISTERS)


def _pairs(regs, n, left, right):
    """(x, y, estimate) of the pairs of a block that may reach the threshold: each row of ``left`` with the later rows of
    the block (``right`` is None) or with the rows of ``right``."""
    for x in left.tolist():
        rest = np.arange(x + 1, len(regs)) if right is None else right
        rest = rest[(4 * n[rest] >= 3 * n[x]) & (4 * n[x] >= 3 * n[rest])]
        if len(rest):
            like = estimate((regs[rest] == regs[x]).sum(axis=1))
            for y, e in zip(rest[like >= ESTIMATE].tolist(), like[like >= ESTIMATE].tolist()):
                yield x, y, e


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = sorted((a, b), key=len)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= 75 * (len(small) + len(large) - both)


def _joined(exact: bool):
    """mapInArrow over sorted (grp, bi, bj, side, cid, label, n, regs[, shingles]): (grp, label, joined) of the labels of a block that
    likely pairs, or pairs confirmed on full sets, connect to a lesser one. Rows of one label are connected already."""
    def run(batches):
        held = []
        for (grp, _, _), group in each_group(batches, 3):
            if group.num_rows < 2:
                continue
            side, label, n = _columns(group, "side", "label", "n")
            names, tree = np.unique(label, return_inverse=True)
            if len(names) < 2:
                continue
            left, right = (np.arange(len(side)), None) if side[0] == 0 else (np.flatnonzero(side == 2), np.flatnonzero(side == 1))
            if right is not None and (len(left) == 0 or len(right) == 0):
                continue
            found = _pairs(_regs(group), n, left, right)
            if exact:
                sets = [np.frombuffer(s.as_buffer(), dtype=U64) for s in group.column("shingles")]
                found = sorted(found, key=lambda p: -p[2])
            forest, trees = Forest(len(names)), len(names)
            for x, y, _ in found:
                if forest.root(tree[x]) != forest.root(tree[y]) and (not exact or _similar(sets[x], sets[y])):
                    forest.join(tree[x], tree[y])
                    trees -= 1
                    if trees == 1:
                        break
            roots = np.array([forest.root(i) for i in range(len(names))])
            moved = np.flatnonzero(roots != np.arange(len(names)))
            if len(moved):
                held.append((np.full(len(moved), grp), names[moved], names[roots[moved]]))
            if len(held) > 1000:
                yield _label_batch(held)
                held = []
        if held:
            yield _label_batch(held)
    return run


def _label_batch(held) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[i] for h in held]).astype(np.int64)) for i in range(3)],
                                      names=["grp", "label", "joined"])


def _in_blocks(rows: DataFrame, payload: DataFrame, exact: bool, name: str) -> DataFrame:
    """(grp, label, joined) found inside the blocks (grp, bi, bj) of (grp, bi, bj, side, cid, label)."""
    keys = ["grp", "bi", "bj"]
    columns = [*keys, "side", "cid", "label", *(c for c in payload.columns if c != "cid")]
    dealt = rows.join(payload, "cid").select(*columns).repartition(*keys).sortWithinPartitions(*keys)
    return stored(dealt.mapInArrow(_joined(exact), "grp long, label long, joined long"), name)


def _blocks(size: str, weight: str | None) -> Column:
    n = F.ceil(F.col(size) / BLOCK)
    return (F.greatest(n, F.ceil(F.col(weight) / BLOCK_SHINGLES)) if weight else n).cast("int")


def _relabelled(members: DataFrame, joined: DataFrame) -> DataFrame:
    return members.join(joined, ["grp", "label"], "left").select("grp", "cid", "n", F.coalesce("joined", "label").alias("label"))


def connect(members: DataFrame, payload: DataFrame, exact: bool, weighed: bool, name: str) -> DataFrame:
    """(cid, root) of the classes that links inside the groups of ``members`` (grp, cid, n) connect to others.

    First only rows of one block of a group are compared. Groups of several blocks go on with one row a label (what is known to be
    connected within the group), again in blocks, until the labels of a group fit a block: a large group of near copies has one label by then, and
    is left out. In groups that still have several, the rows outside the largest meet all rows of other labels, block by
    block. A block returns which of its labels are connected, so edges never grow with the pairs of a group."""
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")).filter("size > 1")
    weight = "weight" if weighed else None
    salt = F.xxhash64("cid")

    def place(n):
        return F.pmod(salt, n).cast("int")

    dealt = stored(members.join(sizes, "grp").select("grp", "cid", "n", _blocks("size", weight).alias("blocks")), f"{name}-members")
    own = dealt.select("grp", place(F.col("blocks")).alias("bi"), F.lit(0).alias("bj"), F.lit(0).alias("side"), "cid",
                       F.col("cid").alias("label"))
    joined = _in_blocks(own, payload, exact, f"{name}-edges")
    edges = joined.select("label", "joined")
    most, now = dealt.agg(F.max("blocks")).first()[0] or 0, None
    if most > 1:
        wide = dealt.filter("blocks > 1").select("grp", "cid", "n", F.col("cid").alias("label"))
        now = stored(_relabelled(wide, joined), f"{name}-labels")
    while most > 1:
        heads = now.groupBy("grp", "label").agg(F.min(F.struct("cid", "n")).alias("x")).select("grp", "label", "x.cid", "x.n")
        of_group = heads.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")).filter("size > 1")
        heads = stored(heads.join(of_group, "grp").select("grp", "label", "cid", _blocks("size", weight).alias("blocks")), f"{name}-heads")
        before, most = most, heads.agg(F.max("blocks")).first()[0] or 0
        if 2 * most > before:
            break  # blocks of representatives connect little more; the rest is compared below
        again = heads.select("grp", place(F.col("blocks")).alias("bi"), F.lit(0).alias("bj"), F.lit(0).alias("side"), "cid", "label")
        joined = _in_blocks(again, payload, exact, f"{name}-edges")
        edges = edges.unionByName(joined.select("label", "joined"))
        now = stored(_relabelled(now, joined), f"{name}-labels")
    if now is None:
        return stored(components(edges, "label", "joined").withColumnRenamed("id", "cid"), f"{name}-roots")

    parts = now.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    stats = (parts.groupBy("grp").agg(F.max(F.struct("c", "label")).alias("major"), F.sum("c").alias("size"), F.sum("w").alias("weight"),
                                      F.count(F.lit(1)).alias("k"))
             .filter("k > 1").select("grp", F.col("major.label").alias("major"), "size", "weight", (F.col("size") - F.col("major.c")).alias("rest"),
                                     _blocks("size", weight).alias("blocks")))
    # The outsiders' blocks are cut like the group's, in proportion to their number.
    stats = stats.withColumn("others", F.greatest(F.lit(1), F.ceil(F.col("blocks") * F.col("rest") / F.col("size"))).cast("int"))
    rows = now.join(stats, "grp")
    every = rows.select("grp", place(F.col("blocks")).alias("bi"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("bj"),
                        F.lit(1).alias("side"), "cid", "label")
    outside = rows.filter("label <> major").select(
        "grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("bi"), place(F.col("others")).alias("bj"), F.lit(2).alias("side"), "cid", "label")
    joined = _in_blocks(every.unionByName(outside.select(*every.columns)), payload, exact, f"{name}-edges")
    edges = edges.unionByName(joined.select("label", "joined"))
    return stored(components(edges, "label", "joined").withColumnRenamed("id", "cid"), f"{name}-roots")


def _full_sets(batches):
    """mapInArrow over (cid, text): the whole set as sorted 64-bit hashes."""
    for batch in batches:
        for at, data, off in slices(batch.column(1)):
            sets = shingle_sets(data, off)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)),
                                              pa.array([s.tobytes() for s in sets], pa.binary())], names=["cid", "shingles"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, k1, root) for every row of ``docs`` (doc_id, text); ``root``
    names the component (null for empty sets), the struct ``k1`` (k1, k2) the text."""
    keyed = docs.select("doc_id", *text_key(F.col("text")), "text")
    signed = stored(keyed.mapInArrow(_sign, "doc_id long, k1 long, k2 long, n long, d1 long, d2 long, regs binary"), "near-signed")
    classes = stored(signed.filter("n > 0").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct("k1", "k2")).alias("key"), F.first("n").alias("n"), F.first("regs").alias("regs"))
        .withColumn("cid", F.monotonically_increasing_id()), "near-classes")

    bands = classes.select("cid", "regs", "n").mapInArrow(_bands, "grp long, cid long, n long")
    likely = connect(bands, classes.select("cid", "n", "regs"), False, False, "near-likely")
    inside = classes.select("cid", "key.k1", "key.k2", "n", "regs").join(likely.withColumnRenamed("root", "grp"), "cid")
    texts = keyed.select("k1", "k2", "text").join(inside.select("k1", "k2", "cid"), ["k1", "k2"]).select("cid", "text")
    sets = texts.mapInArrow(_full_sets, "cid long, shingles binary").groupBy("cid").agg(F.first("shingles").alias("shingles"))
    full = stored(inside.select("grp", "cid", "n", "regs").join(sets, "cid"), "near-sets")
    groups = connect(full.select("grp", "cid", "n"), full.drop("grp"), True, True, "near-links")

    ids = classes.select("cid", "d1", "d2", "first_id").join(groups, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = ids.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = ids.join(least, "root").select("d1", "d2", "component_id", "root")
    out = signed.select("doc_id", "k1", "k2", "n", "d1", "d2").join(of_class, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), F.struct("k1", "k2").alias("k1"), "root")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any other columns) that stay: of each component the one with
    the least id (null ids last, then by text hash), and one of each repeated row with an empty set."""
    found = near_duplicates(docs.select("doc_id", "text"))
    best = (found.filter("root IS NOT NULL").groupBy("root")
            .agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "k1")).alias("b")).select("b.doc_id", "b.k1.k1", "b.k1.k2"))
    empty = found.filter("root IS NULL").select("doc_id", "k1.k1", "k1.k2").distinct()
    a1, a2, i, b1, b2 = unused(docs, "k1", "k2", "id", "key1", "key2")
    keys = stored(best.unionByName(empty).toDF(i, b1, b2), "near-kept")
    keyed = docs.withColumns(dict(zip((a1, a2), text_key(F.col("text")))))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(a1) == F.col(b1)) & (F.col(a2) == F.col(b2))
    return keyed.join(keys, same, "left_semi").dropDuplicates(["doc_id", a1, a2]).drop(a1, a2)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document at similarity 0.75."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text")).drop("k1", "root")
