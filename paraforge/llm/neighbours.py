"""Near-duplicate embeddings by NN-descent on a neighbour graph, in double precision.

1. Equal vectors become one class with a weight. Null vectors, and vectors with null or non-finite
   components or of length 0, are left out: they link with nothing.
2. The first graph comes from random projections: in each table a class falls into the bucket of its sign
   bits (as many that buckets hold about ``BLOCK`` classes). The number of tables follows the bits, so that two
   vectors at cosine ``THRESHOLD`` share no bucket of a pass with probability ``MISS`` at most. Buckets that a
   dense region fills are cut by further sign bits, and then dealt to blocks of bounded size,
   and a block proposes the best ``K`` partners of each member (cosine of at least ``FLOOR``) and a spanning
   forest of all its links, so members with more links than ``K`` lose no connection within the block.
3. A round of NN-descent joins each vertex's neighbours and reverse neighbours with each other (in bounded
   blocks, all of them: popular vertices have several blocks) and keeps the best ``K`` of the old and new ones. Only
   vertices with a fresh neighbour take part. Rounds go on until hardly any new link appears.
4. Lists full of links of their own group hide links to other groups. So further passes with new tables propose
   only pairs of different components found so far, joined with the graph kept, until a pass finds no link.
5. Recall is audited: ``AUDIT`` vertices chosen by hash, and as many of small groups, are compared with all
   vectors. The mean over the vertices of either sample must reach ``RECALL``; else more passes follow. Passes draw new
   tables, so a pair is missed by n of them with probability ``MISS`` ** n at most, and the passes come to an end.
6. A list whose ``K`` entries are all links is saturated and may hide more. So the lists of linked vertices
   are enlarged to their whole component: members are compared in pairs of bounded blocks, which
   counts every link inside the component exactly and returns counts, not pairs.

Only vectors of one dimension are compared with each other. Labels and other columns are not used. Repeated
rows and null ids are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paraforge.llm.blocks import block_pairs, each_group
from paraforge.llm.common import stored, table
from paraforge.llm.graph import components
from paraforge.llm.words import as_signed, mix

THRESHOLD = 0.9
FLOOR = 0.5
K = 10
BLOCK = 256
COUNT_BLOCK, COUNT_ROWS = 4096, 512
LEAST_TABLES = 16
MISS = 1e-3
FINER = 16
AUDIT = 200
RECALL = 0.98
MAX_ROUNDS = 6
FRESH_SHARE = 0.01
PAIR = "a long, b long, s double"


def unit_rows(vectors: list[bytes], kind: str) -> np.ndarray:
    """Unit rows in double precision from packed vectors of one dimension."""
    rows = np.frombuffer(b"".join(vectors), dtype=kind).reshape(len(vectors), -1).astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _pack(kind: str):
    """mapInArrow over (row columns..., embedding): the vector packed, null if it links with nothing."""
    def run(batches):
        for batch in batches:
            out = []
            for vector in batch.column(batch.num_columns - 1):
                values = vector.values if vector.is_valid else None
                if values is None or len(values) == 0 or values.null_count:
                    out.append(None)
                    continue
                array = np.asarray(values).astype(kind)
                out.append(array.tobytes() if np.isfinite(array).all() and array.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns - 1)]
                                             + [pa.array(out, pa.binary())], names=batch.schema.names)
    return run


def _sign_buckets(kind: str, bits: int, tables: range):
    """mapInArrow over (c, vec): one (bucket, finer, c) per table; ``finer`` are ``FINER`` further sign bits."""
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors, ids = batch.column(1).to_pylist(), np.asarray(batch.column(0))
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                rows = unit_rows([vectors[i] for i in own], kind)
                dim = rows.shape[1]
                if dim not in planes:
                    planes[dim] = np.stack([np.random.default_rng([t, dim]).standard_normal((dim, bits + FINER)) for t in tables])
                weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)
                fine = 1 << np.arange(FINER, dtype=np.int64)
                for t, plane in zip(tables, planes[dim]):
                    signs = (rows @ plane) > 0
                    code = signs[:, :bits].astype(np.uint64) @ weights
                    bucket = mix(code ^ mix(np.full(len(code), t * 100_003 + dim, dtype=np.uint64)))
                    finer = signs[:, bits:].astype(np.int64) @ fine
                    yield pa.RecordBatch.from_arrays([pa.array(as_signed(bucket)), pa.array(finer), pa.array(ids[own])],
                                                     names=["bucket", "finer", "c"])
    return run


def n_tables(bits: int) -> int:
    """Tables of ``bits`` sign bits after which a pair at cosine ``THRESHOLD`` shared none with probability ``MISS``."""
    shared = (1 - np.arccos(THRESHOLD) / np.pi) ** bits
    return max(LEAST_TABLES, int(np.ceil(np.log(MISS) / np.log1p(-shared))))


def _cut_full(buckets: DataFrame) -> DataFrame:
    """(bucket, c) of (bucket, finer, c): buckets beyond ``BLOCK`` are cut by as many further sign bits as they need."""
    full = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
    mask = F.pow(F.lit(2.0), F.least(F.lit(FINER), F.ceil(F.log2(F.col("n") / BLOCK)))).cast("long")
    return buckets.join(full, "bucket", "left").select(
        F.when(F.col("n").isNull(), F.col("bucket"))
        .otherwise(F.xxhash64("bucket", F.pmod(F.col("finer"), mask))).alias("bucket"), "c")


def _propose(kind: str):
    """mapInArrow over sorted (group, block, c, root, vec): the best partners of each member of a block in other
    components, and a spanning forest of all such links."""
    def run(batches):
        held = []
        for _, group in each_group(batches, 2):
            if group.num_rows < 2:
                continue
            vectors = group.column("vec").to_pylist()
            ids, roots = (np.asarray(group.column(x).combine_chunks()) for x in ("c", "root"))
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                if len(own) < 2:
                    continue
                rows = unit_rows([vectors[i] for i in own], kind)
                like = rows @ rows.T
                like[roots[own][:, None] == roots[own][None, :]] = -2
                k = min(K, len(own) - 1)
                best = np.argpartition(-like, k - 1, axis=1)[:, :k]
                x = np.repeat(np.arange(len(own)), k)
                y = best.ravel()
                near = like >= THRESHOLD
                if (near.sum(axis=1) > k).any():
                    more = _forest(near)
                    x, y = np.concatenate([x, more[0]]), np.concatenate([y, more[1]])
                s = like[x, y]
                good = s >= FLOOR
                x, y, s = ids[own[x[good]]], ids[own[y[good]]], s[good]
                held.append((np.minimum(x, y), np.maximum(x, y), s))
            if len(held) > 200:
                yield _pair_batch(held)
                held = []
        if held:
            yield _pair_batch(held)
    return run


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of a spanning forest of a symmetric adjacency matrix."""
    left = near.any(axis=1)
    xs, ys = [], []
    while left.any():
        todo = [int(left.argmax())]
        left[todo[0]] = False
        while todo:
            x = todo.pop()
            y = np.flatnonzero(near[x] & left)
            left[y] = False
            xs.append(np.full(len(y), x))
            ys.append(y)
            todo += y.tolist()
    return np.concatenate(xs), np.concatenate(ys)


def _pair_batch(held) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[i] for h in held])) for i in range(3)],
                                      names=["a", "b", "s"])


def _count_links(kind: str):
    """mapInArrow over sorted (root, bi, bj, side, c, w, vec): links of each member within a block pair."""
    def run(batches):
        held = []
        for _, group in each_group(batches, 3):
            ids, weight, side = (np.asarray(group.column(x).combine_chunks()) for x in ("c", "w", "side"))
            vectors = group.column("vec").to_pylist()
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                rows, part = unit_rows([vectors[i] for i in own], kind), side[own]
                # inside a block every row meets all others, across blocks each side the other one
                for left, right in [(part == 3, part == 3), (part == 1, part == 2), (part == 2, part == 1)]:
                    left, right = np.flatnonzero(left), np.flatnonzero(right)
                    for at in range(0, len(left) if len(right) else 0, COUNT_ROWS):
                        some = left[at:at + COUNT_ROWS]
                        near = rows[some] @ rows[right].T >= THRESHOLD
                        near &= some[:, None] != right[None, :]
                        held.append((ids[own[some]], near @ weight[own[right]]))
            if len(held) > 500:
                yield _count_batch(held)
                held = []
        if held:
            yield _count_batch(held)
    return run


def _count_batch(held) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[0] for h in held])),
                                       pa.array(np.concatenate([h[1] for h in held]).astype(np.int64))], names=["c", "n"])


def _in_blocks(members: DataFrame, group: str, classes: DataFrame, kind: str) -> DataFrame:
    """Proposed pairs of (group, c) rows, each group dealt to blocks of about ``BLOCK``."""
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    dealt = (members.join(sizes, group)
             .select(F.col(group).alias("g"), F.pmod(F.xxhash64("c", group), F.ceil(F.col("size") / BLOCK)).alias("block"), "c")
             .join(classes.select("c", "root", "vec"), "c").select("g", "block", "c", "root", "vec"))
    return dealt.repartition("g", "block").sortWithinPartitions("g", "block").mapInArrow(_propose(kind), PAIR)


def _best(pairs: DataFrame) -> DataFrame:
    """The pairs that are among the best ``K`` of either end (a, b, s, fresh)."""
    ends = pairs.select(F.col("a").alias("v"), "a", "b", "s", "fresh").unionByName(
        pairs.select(F.col("b").alias("v"), "a", "b", "s", "fresh"))
    order = Window.partitionBy("v").orderBy(F.col("s").desc(), "a", "b")
    top = ends.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= K)
    return top.groupBy("a", "b").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))


def _round(graph: DataFrame, kept: DataFrame | None, classes: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """One neighbours-of-neighbours join over the graph and the pairs ``kept`` of earlier passes: the pairs it
    proposes, and the new graph, with ``fresh`` for pairs that were not in the old one."""
    every = graph if kept is None else graph.unionByName(kept.withColumn("fresh", F.lit(False)))
    both = every.select(F.col("a").alias("v"), F.col("b").alias("c"), "fresh").unionByName(
        every.select(F.col("b").alias("v"), F.col("a").alias("c"), "fresh"))
    active = both.groupBy("v").agg(F.max("fresh").alias("any")).filter("any").select("v")
    members = both.select("v", "c").distinct().join(active, "v")
    found = stored(_in_blocks(members, "v", classes, kind).groupBy("a", "b").agg(F.max("s").alias("s")), "proposed")
    return found, stored(_best(_merged(graph, found)), "graph")


def _merged(graph: DataFrame, found: DataFrame) -> DataFrame:
    return (graph.select("a", "b", "s", F.lit(False).alias("fresh"))
            .unionByName(found.withColumn("fresh", F.lit(True)))
            .groupBy("a", "b").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh")))


def _audit(rooted: DataFrame, kind: str, salt: int) -> float:
    """The mean over sampled classes with true links of the share of these links within one component, over (c,
    vec, root): the lower one of a sample of all classes and a sample of those in components of at most ``K``."""
    sizes = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    small = rooted.join(sizes.filter(F.col("size") <= K).select("root"), "root").select("c", "vec", "root")
    order = F.xxhash64(F.lit(salt), "c")
    return min(_mean_recall(rooted, some.orderBy(order, "c").limit(AUDIT).collect(), kind)
               for some in (rooted.select("c", "vec", "root"), small))


def _mean_recall(rooted: DataFrame, sample: list, kind: str) -> float:
    """The audit of at most ``AUDIT`` rows (c, vec, root) against all; their links are only counted."""
    ids, own_roots = (np.array([r[x] for r in sample], dtype=np.int64) for x in ("c", "root"))
    vectors = [bytes(r["vec"]) for r in sample]

    def true_links(batches):
        n, hit = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for batch in batches:
            own, roots, some = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2).to_pylist()
            for size in {len(v) for v in vectors}:
                left = [i for i, v in enumerate(vectors) if len(v) == size]
                right = [i for i, v in enumerate(some) if len(v) == size]
                if right:
                    near = unit_rows([vectors[i] for i in left], kind) @ unit_rows([some[i] for i in right], kind).T >= THRESHOLD
                    near &= ids[left][:, None] != own[right][None, :]
                    n[left] += near.sum(axis=1)
                    hit[left] += (near & (own_roots[left][:, None] == roots[right][None, :])).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(hit)], names=["c", "n", "hit"])

    if not sample:
        return 1.0
    counts = (rooted.select("c", "root", "vec").mapInArrow(true_links, "c long, n long, hit long")
              .groupBy("c").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit")).filter("n > 0"))
    mean = counts.agg(F.avg(F.col("hit") / F.col("n"))).first()[0]
    return 1.0 if mean is None else mean


def _still_fresh(graph: DataFrame) -> bool:
    """Whether more than ``FRESH_SHARE`` of the linked vertices with room in their lists have a fresh link."""
    near = graph.filter(F.col("s") >= THRESHOLD)
    ends = near.select(F.col("a").alias("v"), "fresh").unionByName(near.select(F.col("b").alias("v"), "fresh"))
    vertices = ends.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.max("fresh").alias("fresh")).filter(F.col("n") < K)
    n, fresh = vertices.agg(F.count(F.lit(1)), F.count(F.when(F.col("fresh"), 1))).first()
    return fresh > FRESH_SHARE * n


def _rooted(classes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(c, vec, root); a class without a link is its own component."""
    if roots is None:
        return classes.select("c", "vec", F.col("c").alias("root"))
    return classes.select("c", "vec").join(roots, "c", "left").select("c", "vec", F.coalesce("root", "c").alias("root"))


def linked_components(classes: DataFrame, kind: str) -> DataFrame:
    """(c, root) of the components of all links that the refined graph over (c, vec) proposed, for vertices
    with a link. The graph itself keeps the best ``K`` pairs of a vertex; links that drop out of it still
    connect, but take no part in later joins. The first pass takes each vertex as a component; the later ones
    propose pairs of different components, until no link is left to find and the audit is met."""
    size = classes.count()
    bits = int(max(1, min(60, np.ceil(np.log2(max(2, size / BLOCK))))))
    kept = links = roots = None
    for step in count():
        tables = range(step * n_tables(bits), (step + 1) * n_tables(bits))
        rooted = _rooted(classes, roots)
        buckets = _cut_full(classes.select("c", "vec").mapInArrow(
            _sign_buckets(kind, bits, tables), "bucket long, finer long, c long"))
        found = stored(_in_blocks(buckets, "bucket", rooted, kind).groupBy("a", "b").agg(F.max("s").alias("s")), "proposed")
        graph = stored(_best(found.withColumn("fresh", F.lit(True))), "graph")
        proposed = [found]
        for _ in range(MAX_ROUNDS):
            found, graph = _round(graph, kept, rooted, kind)
            proposed.append(found)
            if not _still_fresh(graph):
                break
        kept = graph if kept is None else stored(_best(_merged(kept, graph.select("a", "b", "s"))), "kept")
        new = [found.filter(F.col("s") >= THRESHOLD).select("a", "b") for found in proposed]
        for near in new:
            links = near if links is None else links.unionByName(near)
        settled = roots is not None and all(near.isEmpty() for near in new)
        if not settled:
            roots = stored(components(links).withColumnRenamed("id", "c"), "vector-roots")
        if settled and _audit(_rooted(classes, roots), kind, step) >= RECALL:
            return roots


def near_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding)."""
    kind = "<f4" if rows.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    packed = stored(rows.select("vec_id", "embedding").mapInArrow(_pack(kind), "vec_id long, vec binary")
                    .select("vec_id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(7), "vec").alias("h2")), "vectors")
    classes = stored(packed.filter("vec IS NOT NULL").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("w"), F.first("vec").alias("vec"))
        .withColumn("c", F.monotonically_increasing_id()), "vector-classes")
    roots = linked_components(classes, kind)

    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    inside = roots.join(sizes, "root").join(classes.select("c", "w", "vec"), "c")
    dealt = block_pairs(inside, F.ceil(F.col("size") / COUNT_BLOCK), F.xxhash64("c")).select("root", "bi", "bj", "side", "c", "w", "vec")
    keys = ["root", "bi", "bj"]
    links = (dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_count_links(kind), "c long, n long")
             .groupBy("c").agg(F.sum("n").alias("n")))

    named = classes.select("c", "h1", "h2", "w", "first_id").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = stored(named.join(least, "root").join(links, "c", "left").select(
        "h1", "h2", "component_id", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links")), "vector-result")
    linked = F.col("vec").isNotNull()
    out = packed.select("vec_id", "h1", "h2", linked.alias("linked")).join(of_class.withColumn("linked", F.lit(True)), ["h1", "h2", "linked"], "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every embedding at cosine 0.9."""
    return near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
