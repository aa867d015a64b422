"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame functions only).

1. Sizes are counted per document and summed per source and per shard (a shard is a seeded hash
   class of a source's documents; a source gets shards in proportion to its share, so a source
   that holds a third of all rows is split into many).
2. Targets: every source's weight share of the total, at most ``max_repeats`` times its size;
   the excess is reshared by weight. That fixed point is found in closed form: with sources
   ordered by cap / weight, the first ones to fill are a prefix.
3. The total is cut into ``blocks`` equal-token blocks. The blocks go to the sources by the
   highest quotients target / (2k + 1), then each source's blocks go to its shards by
   the highest quotients size / (2k + 1). Seats that a party gets in any case (from the bounds
   of the divisor) are given at once; only the few uncertain quotients are listed and ranked.
4. Within a shard the documents lie in seeded order on a line of tokens that is cut into blocks.
   A quota of q tokens takes the whole line q div length times, and the rest from blocks in
   seeded order. So no document is taken more often than ``max_repeats`` times.

Null texts have size 0 and null sources are a source of their own (last). Empty input gives an
empty result. Rows with the same id are documents of their own. Reruns agree: all orders are
seeded hashes of ids and texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paraforge.llm.common import WORD, stored, table, unused

BLOCKS = 100_000
SHARD_BLOCKS = 64
MAX_REPEATS = 3.0
CELL_DOCS = 4096
SEED = 42


def _tie() -> Column:
    """A seeded order of documents by id and text."""
    return F.xxhash64(F.lit(SEED), "doc_id", F.xxhash64("text"))


def document_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, tie): the words of each whole text and a seeded order."""
    return docs.select(
        "doc_id", "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _tie().alias("tie"))


def targets(sources: DataFrame, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """Add ``weight`` and ``target`` to one row per source (source, source_size).

    Water filling: sources are ordered by cap / weight; when those before a source are filled to
    their caps, the level of the rest is (total - filled) / (remaining weight). A source is
    filled if the level reached at its turn is at least its own cap / weight. The windows run
    over one row per source, not over documents."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    ranked = sources.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    ranked = ranked.withColumn("cap", F.lit(max_repeats) * F.col("source_size"))
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = (Window.orderBy("ratio", F.col("source").asc_nulls_last())
              .rowsBetween(Window.unboundedPreceding, -1))
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    ranked = ranked.withColumn("level", level)
    # the level only rises over the filled ones; the first unfilled source gives the level of all others
    turn = F.row_number().over(Window.orderBy("ratio", F.col("source").asc_nulls_last()))
    ranked = ranked.withColumn("turn", turn)
    first_open = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("turn", "level"))).over(everything)
    ranked = ranked.withColumn("open", first_open)
    full = F.coalesce(F.col("turn") < F.col("open.turn"), F.lit(True))
    return (ranked.withColumn("target", F.when(full, F.col("cap"))
                              .otherwise(F.col("weight") * F.col("open.level")))
            .select("source", "source_size", "weight", "target"))


def apportion(parties: DataFrame, group: list[str], votes: str, seats: str, tie: Column,
              out: str) -> DataFrame:
    """Sainte-Lague: give the ``seats`` of each group to its parties by the highest quotients
    votes / (2k + 1), ties by ``tie``.

    With n parties of V votes the final divisor lies so that a party of quota q = votes * seats / V
    gets at least q * (1 - n / 2S) - 1/2 and at most q * (1 + n / 2S) + 1/2 seats, S being the seats
    less or plus n / 2. Seats below the lower bound are given at once, and the quotients between
    both bounds are ranked for the rest."""
    whole = Window.partitionBy(*group)
    v, s = F.col(votes).cast("double"), F.col(seats).cast("double")
    n = F.count(F.lit(1)).over(whole)
    total = F.sum(v).over(whole)
    df = (parties.withColumn("_n", n).withColumn("_v", total)
          .withColumn("_tie", tie)
          .withColumn("_low", F.when(F.col("_v") > 0, F.greatest(
              F.lit(0), F.floor(v * (s - F.col("_n") / 2) / F.col("_v") - 0.5))).otherwise(0))
          .withColumn("_high", F.when(F.col("_v") > 0, F.ceil(
              v * (s + F.col("_n") / 2) / F.col("_v") + 0.5)).otherwise(0))
          .withColumn("_rest", F.col(seats) - F.sum("_low").over(whole)))
    listed = df.select("*", F.explode(F.when(
        (F.col("_high") > F.col("_low")) & (v > 0),
        F.sequence(F.col("_low").cast("long"), (F.col("_high") - 1).cast("long")))).alias("_k"))
    order = Window.partitionBy(*group).orderBy((v / (2 * F.col("_k") + 1)).desc(), "_tie", "_k")
    won = (listed.withColumn("_rank", F.row_number().over(order))
           .filter(F.col("_rank") <= F.col("_rest"))
           .groupBy(*group, "_tie").agg(F.count(F.lit(1)).alias("_more")))
    keep = [c for c in df.columns if c not in ("_n", "_v", "_high", "_rest")]
    on = [F.col(f"p.{c}").eqNullSafe(F.col(f"w.{c}")) for c in [*group, "_tie"]]
    joined = df.select(*keep).alias("p").join(won.alias("w"), on, "left")
    return joined.select(*[F.col(f"p.{c}") for c in keep if c not in ("_low", "_tie")],
                         (F.col("p._low") + F.coalesce(F.col("w._more"), F.lit(0))).cast("long").alias(out))


def mix(docs: DataFrame, blocks: int = BLOCKS, shard_blocks: int = SHARD_BLOCKS,
        max_repeats: float = MAX_REPEATS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, tie) for every row of ``docs``."""
    sizes = stored(document_sizes(docs), "mix-sizes")
    sources = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), max_repeats)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    sources = sources.withColumn("block", F.greatest(F.lit(1.0), total / F.lit(float(blocks))))
    sources = (sources.withColumn("_all", F.lit(0))
               .withColumn("seats", F.round(F.sum("target").over(Window.partitionBy(F.lit(0)))
                                            / F.col("block")).cast("long")))
    sources = apportion(sources, ["_all"], "target", "seats", F.xxhash64(F.lit(SEED), "source"), "quota")
    sources = stored(sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(
        F.col("source_size") / F.col("block") / shard_blocks)).cast("long"))
        .drop("_all", "seats"), "mix-sources")

    # one row per source; a name check keeps null sources together
    placed = (sizes.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
              .select("d.*", "s.source_size", "s.target", "s.block", "s.quota",
                      F.pmod(F.xxhash64(F.lit(SEED + 1), "d.tie"), F.col("s.shards")).alias("shard")))
    cell = ["source", "shard"]
    cells = (placed.groupBy(*cell).agg(F.sum("size").alias("cell_size"), F.first("block").alias("block"),
                                       F.first("quota").alias("source_quota")))
    cells = apportion(cells, ["source"], "cell_size", "source_quota",
                      F.xxhash64(F.lit(SEED + 2), "source", "shard"), "cell_quota")
    # whole passes over the line of the cell, and the blocks of the rest; never beyond the cap
    most = F.lit(max_repeats) * F.col("cell_size")
    tokens = F.least(F.floor(F.col("cell_quota") * F.col("block")), F.floor(most)).cast("long")
    cells = (cells.withColumn("tokens", tokens)
             .withColumn("passes", F.when(F.col("cell_size") > 0,
                                          F.floor(F.col("tokens") / F.col("cell_size"))).otherwise(0).cast("long"))
             .withColumn("rest", F.col("tokens") - F.col("passes") * F.col("cell_size"))
             .withColumn("n_blocks", F.greatest(F.lit(1), F.floor(F.col("cell_size") / F.col("block"))).cast("long"))
             .select(*cell, "cell_size", "passes", "rest", "n_blocks"))
    cells = stored(cells, "mix-cells")

    on = lambda a, b: (F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
                       & (F.col(f"{a}.shard") == F.col(f"{b}.shard")))
    # blocks of a cell: [cell_size * b div n, cell_size * (b + 1) div n), taken in seeded order
    edge = lambda b: F.floor(F.col("cell_size") * b / F.col("n_blocks")).cast("long")
    listed = (cells.filter("rest > 0")
              .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("b"))
              .withColumn("length", edge(F.col("b") + 1) - edge(F.col("b"))))
    seeded = (Window.partitionBy(*cell).orderBy(F.xxhash64(F.lit(SEED + 3), "source", "shard", "b"), "b")
              .rowsBetween(Window.unboundedPreceding, -1))
    chosen = (listed.withColumn("_before", F.coalesce(F.sum("length").over(seeded), F.lit(0)))
              .withColumn("part", F.least(F.col("length"), F.col("rest") - F.col("_before")))
              .filter("part > 0")
              .select(*cell, "b", edge(F.col("b")).alias("b_from"), "part"))

    line = Window.partitionBy(*cell).orderBy("tie", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    laid = (placed.select("doc_id", "source", "shard", "size", "tie", "source_size", "target")
            .withColumn("to", F.sum("size").over(line))
            .withColumn("from", F.col("to") - F.col("size")).alias("d")
            .join(cells.alias("c"), on("d", "c"))
            .select("d.*", "c.cell_size", "c.passes", "c.n_blocks"))
    # A block index is floor(place * n / size) or one less or more (rounding), so all are tried.
    at = lambda x: F.floor(x * F.col("n_blocks") / F.col("cell_size"))
    touched = F.when(F.col("size") > 0, F.sequence(
        F.greatest(F.lit(0), at(F.col("from")) - 1).cast("long"),
        F.least(F.col("n_blocks") - 1, at(F.col("to")) + 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    pieces = (laid.withColumn("b", F.explode(touched)).alias("d")
              .join(chosen.alias("k"), on("d", "k") & (F.col("d.b") == F.col("k.b")), "left")
              .withColumn("got", F.when(F.col("b_from").isNotNull(), F.greatest(
                  F.lit(0), F.least(F.col("to"), F.col("b_from") + F.col("part"))
                  - F.greatest(F.col("from"), F.col("b_from")))).otherwise(0)))
    keys = ["doc_id", "d.source", "d.shard", "tie", "from", "to"]
    # rows that agree in every key column lie at different places of the line or have size 0
    return (pieces.groupBy(*[F.col(k) for k in keys])
            .agg(F.max("size").alias("size"), F.max("source_size").alias("source_size"),
                 F.max("target").alias("target"), F.max("passes").alias("passes"),
                 F.sum("got").alias("rest"),
                 F.count(F.lit(1)).alias("_rows"),
                 F.countDistinct("d.b").alias("_blocks"))
            .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), (F.col("_rows") / F.col("_blocks")).cast("long"))))
            .select("doc_id", "source", "size", "source_size", "target",
                    (F.col("passes") * F.col("size") + F.when(F.col("size") > 0, F.col("rest")).otherwise(0)).alias("taken"),
                    "tie"))


def whole_copies(taken: DataFrame) -> DataFrame:
    """(doc_id, tie, source, copies) of the rows of a mix. Each document comes taken div size times; the tokens that
    are left in a cell (about ``CELL_DOCS`` documents of a source) go to one more copy of documents in seeded order, up
    to the document that comes nearest to them. So a cell is off by half a document at most."""
    docs = taken.filter("size > 0").withColumn("whole", F.floor(F.col("taken") / F.col("size")).cast("int"))
    docs = stored(docs.withColumn("rest", F.col("taken") - F.col("whole") * F.col("size"))
                  .select("doc_id", "tie", "source", "size", "whole", "rest"), "mix-copies")
    open_ = docs.filter("rest > 0")
    cells = open_.groupBy(F.col("source").alias("_s")).agg(F.ceil(F.count(F.lit(1)) / CELL_DOCS).alias("cells"))
    dealt = (open_.join(cells, F.col("source").eqNullSafe(F.col("_s")))
             .withColumn("cell", F.pmod(F.xxhash64(F.lit(SEED + 4), "tie"), F.col("cells"))))
    cell = Window.partitionBy("source", "cell")
    seeded = cell.orderBy(F.xxhash64(F.lit(SEED + 5), "tie", "doc_id"), "rest").rowsBetween(Window.unboundedPreceding, -1)
    more = (dealt.withColumn("left", F.sum("rest").over(cell)).withColumn("before", F.coalesce(F.sum("size").over(seeded), F.lit(0)))
            .select("doc_id", "tie", "source", (F.col("whole") + (2 * F.col("before") + F.col("size") <= 2 * F.col("left")).cast("int"))
                    .alias("copies")))
    return (docs.filter("rest = 0").select("doc_id", "tie", "source", F.col("whole").alias("copies")).unionByName(more)
            .groupBy("doc_id", "tie", "source").agg(F.sum("copies").cast("int").alias("copies")).filter("copies > 0"))


def mixed_rows(docs: DataFrame, **settings) -> DataFrame:
    """The rows of the mix: each row of ``docs`` as often as ``whole_copies`` says."""
    own, i, tie, source, n = unused(docs, "own_tie", "mix_id", "mix_tie", "mix_source", "copies")
    copies = whole_copies(mix(docs.select("doc_id", "text", "source"), **settings)).select(
        F.col("doc_id").alias(i), F.col("tie").alias(tie), F.col("source").alias(source), F.col("copies").alias(n))
    keyed = docs.withColumn(own, _tie()).dropDuplicates(["doc_id", own, "source"])
    return (keyed.join(copies, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(own) == F.col(tie))
                       & F.col("source").eqNullSafe(F.col(source)))
            .withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n))))
            .select(*docs.columns))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of documents."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
