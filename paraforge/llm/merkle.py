"""Merkle manifest of a dataset, checked by a recursive query that climbs from every leaf.

H is the lowercase hex sha256 of its inputs concatenated (digests as hex text). A row's leaf is H of its fields, each ``-`` if null,
else its UTF-8 byte count, ``:`` and its value. Per source, leaves ascend by doc_id; every ``FAN`` consecutive nodes become
their H until one is left, the source's subroot (a lone leaf itself). Subroots, ordered by source, give the root likewise.

*Build.* Leaves get their place in the source from a range-partitioned rank; each level is one aggregation by (source, place div 16)
and a sixteenth of the level below. Built levels are stored as node rows: a node's key, the digests of its run, and its parent's key and
the place in the parent's run. Only digests are shuffled, never texts.

*Climb.* ``WITH RECURSIVE`` starts from the runs of leaves and joins each with its parent until there is none. A row holds the up to 16 leaves of one
run, as these share all further siblings: every leaf is folded on its own, the siblings are appended once a run. Each step
puts the digest so far between the parent's other digests and hashes.

The nodes near the root are parents of very many rows. Runs of leaves are dealt to chunks of 4096 neighbours, and a node
comes once for each chunk below it, so a join key never has more than 4096 rows; nodes up to level 4 come once.

Ties: rows with one doc_id in a source ascend by their leaf; null ids and the null source come first; a null source is not the
empty one. Repeated rows are leaves of their own. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paraforge.llm.common import LOWER, UPPER, join_hot, stored, table
from paraforge.operators.ranking import with_global_rank

# Fixed values of the contract.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 16
TAMPER_EVERY = 5

DIGEST = 32  # bytes; tables hold digests as bytes, and H reads their hex text
NODE = ("grp", "level", "place", "run", "up_grp", "up_level", "up_place", "up_at")
CHUNK_LEVELS = 3
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def leaf_digest(*fields: Column) -> Column:
    """H of the fields, each with its length, so that no two rows share their input."""
    def part(field):
        value = field.cast("string")
        return F.when(field.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))
    return F.sha2(F.concat(*map(part, fields)), 256)


def tampered(doc_id: Column) -> Column:
    """Whether the row's text is tampered with; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % TAMPER_EVERY == 0, F.lit(False))


@dataclass
class Manifest:
    """``leaves``: the runs of leaves (grp, place, n leaves in the source, items); ``nodes``: the built levels (grp, level, place, run, key of
    the parent and place in it); ``sources`` (grp, source, n, subroot); the root (None for no rows). The tree over the subroots is group -1."""
    leaves: DataFrame
    nodes: DataFrame
    sources: DataFrame
    root: str | None


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _joined(digests: str) -> Column:
    """An array of digests as one run of bytes."""
    return F.unhex(F.concat_ws("", F.transform(digests, lambda d: F.hex(d))))


def _levels(bottom: DataFrame, level: int, name: str) -> tuple[list[DataFrame], DataFrame | None]:
    """The stored levels above ``bottom`` (grp, place, n, digest; n nodes in the group) and (grp, digest) of the tops;
    a group leaves the loop when it has one node. The number of levels is log16 of the largest group."""
    most = bottom.agg(F.max("n")).first()[0] or 0
    built, tops, now = [], bottom.filter("n = 1").select("grp", "digest"), bottom.withColumn("total", F.col("n"))
    while most > 1:
        level += 1
        runs = (now.filter("n > 1").groupBy("grp", F.expr(f"place div {FAN}").alias("place"))
                .agg(F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("below"),
                     F.expr(f"max((n + {FAN - 1}) div {FAN})").alias("n"), F.max("total").alias("total")))
        now = stored(runs.select("grp", F.lit(level).alias("level"), "place", "n", "total", _joined("below.digest").alias("run"))
                     .withColumn("digest", F.unhex(F.sha2(_hex(F.col("run")), 256))), name)
        built.append(now)
        tops = tops.unionByName(now.filter("n = 1").select("grp", "digest"))
        most = -(-most // FAN)
    return built, tops


def _parent() -> list[Column]:
    """The key of a node's parent and its place there: inside its group, or in the tree over the subroots."""
    inside, over = F.col("n") > 1, (F.col("grp") >= 0) & (F.col("n_groups") > 1)
    return [F.when(inside, F.col("grp")).when(over, F.lit(-1)).cast("long").alias("up_grp"),
            F.when(inside, F.col("level") + 1).when(over, F.lit(1)).cast("int").alias("up_level"),
            F.when(inside, F.expr(f"place div {FAN}")).when(over, F.expr(f"grp div {FAN}")).cast("long").alias("up_place"),
            F.when(inside, F.col("place") % FAN).when(over, F.col("grp") % FAN).cast("int").alias("up_at")]


def build(docs: DataFrame, fields=FIELDS, changed: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``, and beside each leaf the digest ``start`` of the row with the ``changed`` columns in place of its
    own (by default the leaf itself), from which ``climb`` goes up."""
    rows = docs.select("doc_id", "source", F.unhex(leaf_digest(*(F.col(f) for f in fields))).alias("leaf"),
                       F.unhex(leaf_digest(*((changed or {}).get(f, F.col(f)) for f in fields))).alias("start"))
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    ranked = with_global_rank(rows, order, "rank")
    ranked = ranked.withColumn("no_source", F.isnull("source")).withColumn("source", F.coalesce("source", F.lit("")))
    groups = stored(ranked.groupBy("no_source", "source").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")),
                    "merkle-groups")
    groups = stored(with_global_rank(groups, [F.desc("no_source"), "source"], "grp"), "merkle-sources")
    total = groups.agg(F.sum("n"), F.count(F.lit(1))).first()
    total, n_groups = total[0] or 0, total[1]
    placed = join_hot(ranked, groups, ["no_source", "source"], "n", total)
    placed = stored(placed.select("grp", "n", (F.col("rank") - F.col("first")).alias("place"), "doc_id", "leaf", "start"), "merkle-leaves")

    levels, tops = _levels(placed.select("grp", "place", "n", F.col("leaf").alias("digest")), 0, "merkle-level")
    subroots = stored(tops, "merkle-subroots")
    over, root = _levels(subroots.select(F.lit(-1).cast("long").alias("grp"), F.col("grp").alias("place"),
                                         F.lit(n_groups).cast("long").alias("n"), "digest"), 0, "merkle-over")
    first = root.first()
    nodes = docs.sparkSession.createDataFrame([], "grp long, level int, place long, n long, total long, run binary")
    for built in [*levels, *over]:
        nodes = nodes.unionByName(built.drop("digest"))
    nodes = nodes.withColumn("n_groups", F.lit(n_groups)).select("*", *_parent()).drop("n_groups")

    # Runs of leaves; the leaf of a source that has no other starts from itself.
    item = F.struct("place", "doc_id", "leaf", "start")
    leaves = (placed.groupBy("grp", F.expr(f"place div {FAN}").alias("place"))
              .agg(F.sort_array(F.collect_list(item)).alias("items"), F.max("n").alias("n")))
    leaves = stored(leaves.withColumn("n_groups", F.lit(n_groups)), "merkle-runs")
    sources = groups.select("grp", F.when(~F.col("no_source"), F.col("source")).alias("source"), "n").join(
        subroots.withColumnRenamed("digest", "subroot"), "grp")
    return Manifest(leaves, nodes, sources, bytes(first["digest"]).hex() if first else None)


def _copies(manifest: Manifest) -> DataFrame:
    """The nodes that the climb meets, once for each chunk of runs of leaves below them: (of_grp, chunk) and the node."""
    per_chunk = FAN ** CHUNK_LEVELS
    width = F.pow(F.lit(float(FAN)), F.col("level") - 1).cast("long")
    runs = F.expr(f"(total + {FAN - 1}) div {FAN}")
    last = F.least((F.col("place") + 1) * width, runs) - 1
    inside = manifest.nodes.filter("grp >= 0 AND level > 1").select(
        F.col("grp").alias("of_grp"),
        F.explode(F.sequence(F.floor(F.col("place") * width / per_chunk).cast("long"), F.floor(last / per_chunk).cast("long"))).alias("chunk"),
        *NODE)
    over = manifest.nodes.filter("grp < 0").select(*NODE)
    levels = over.agg(F.max("level")).first()[0]
    if not levels:
        return inside
    chunks = manifest.sources.select(
        F.col("grp").alias("of_grp"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"((n + {FAN - 1}) div {FAN} - 1) div {per_chunk}"))).alias("chunk"))
    above = chunks.select("*", F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level")).withColumn(
        "place", F.floor(F.col("of_grp") / F.pow(F.lit(float(FAN)), F.col("level"))).cast("long"))
    return inside.unionByName(above.join(over, ["level", "place"]).select("of_grp", "chunk", *NODE))


# SQL for a node's digests before and after the place ``at``, for their parent over a digest between them, and for one step up.
BEFORE, AFTER = f"substr({{run}}, 1, {DIGEST} * {{at}})", f"substr({{run}}, {DIGEST} * ({{at}} + 1) + 1)"
FOLD = "unhex(sha2(lower(hex(concat({before}, {digest}, {after}))), 256))"
CLIMB = """WITH RECURSIVE climb(grp, chunk, place, folded, proof, subroot, up_grp, up_level, up_place, up_at) AS (
SELECT grp, chunk, place, folded, proof, subroot, up_grp, up_level, up_place, up_at FROM {leaves}
UNION ALL
SELECT c.grp, c.chunk, c.place, transform(c.folded, f -> {fold}), concat(c.proof, {before}, {after}),
  coalesce(c.subroot, CASE WHEN n.grp < 0 THEN substr(n.run, {digest} * c.up_at + 1, {digest}) END), n.up_grp, n.up_level, n.up_place, n.up_at
FROM climb c JOIN {nodes} n
  ON c.grp = n.of_grp AND c.chunk = n.chunk AND c.up_grp = n.grp AND c.up_level = n.level AND c.up_place = n.place)
SELECT grp, place, folded, proof, subroot FROM climb WHERE up_grp IS NULL"""


def climb(manifest: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root) of every leaf: the siblings' digests from the leaf up, and the root that
    follows from them and the leaf's ``start``."""
    spark = manifest.leaves.sparkSession
    own = {"run": "run", "at": "i"}
    fold = FOLD.format(before=BEFORE.format(**own), digest="items[i].start", after=AFTER.format(**own))
    runs = manifest.leaves.withColumn("run", _joined("items.leaf"))
    # A run of leaves is a node of level 1, or of level 0 where the source has one leaf, which starts as itself.
    lone = F.col("n") == 1
    base = runs.withColumns({
        "chunk": F.expr(f"place div {FAN ** CHUNK_LEVELS}"), "proof": F.lit(b""), "subroot": F.lit(None).cast("binary"),
        "folded": F.when(lone, F.col("items.start")).otherwise(F.expr(f"transform(sequence(0, size(items) - 1), i -> {fold})")),
        "level": F.when(lone, 0).otherwise(1), "n": F.expr(f"(n + {FAN - 1}) div {FAN}")})
    base = stored(base.select("grp", "chunk", "place", "folded", "proof", "subroot", *_parent()), "merkle-base")
    names = {k: f"merkle_{k}_{uuid.uuid4().hex[:12]}" for k in ("leaves", "nodes")}
    base.createOrReplaceTempView(names["leaves"])
    stored(_copies(manifest), "merkle-nodes").createOrReplaceTempView(names["nodes"])
    step = {"run": "n.run", "at": "c.up_at"}
    limit = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        around = {"before": BEFORE.format(**step), "after": AFTER.format(**step)}
        top = stored(spark.sql(CLIMB.format(fold=FOLD.format(digest="f", **around), digest=DIGEST, **around, **names)),
                     "merkle-climbed")
    finally:
        if limit is None:
            spark.conf.unset(ROW_LIMIT)
        else:
            spark.conf.set(ROW_LIMIT, limit)
        for name in names.values():
            spark.catalog.dropTempView(name)
    siblings = F.when(lone, F.lit(b"")).otherwise(F.concat(F.expr(BEFORE.format(run="run", at="at")), F.expr(AFTER.format(run="run", at="at"))))
    each = runs.join(top, ["grp", "place"]).select("n", "run", "folded", "proof", "subroot", F.posexplode("items").alias("at", "item"))
    root = F.lit(manifest.root)
    return each.select("item.doc_id", _hex(F.col("item.leaf")).alias("leaf"), F.coalesce(_hex(F.col("subroot")), root).alias("subroot"),
                       root.alias("root"), _hex(F.concat(siblings, "proof")).alias("proof"), _hex(F.get("folded", "at")).alias("folded_root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document."""
    docs = table(spark, sf_dir, "documents", *FIELDS)
    text = F.when(tampered(F.col("doc_id")), F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    rows = climb(build(docs, changed={"text": text}))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))
