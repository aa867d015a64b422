"""Best-of-n selection (C1-C7) and candidate scoring.

Two physical forms of the same rules:

* **long** (``select_long``): candidates arrive as rows; the pick is ``min`` of a struct
  ``(overlap, gen_idx, text)`` over the rows that pass the rule, per sentence. That is an
  ordinary aggregate with map-side partial aggregation, so a sentence with many candidates never
  gathers them in one place, and ties go to the earliest generated candidate as with Python's
  stable ``min``.
* **nested** (``select_nested``): candidates are an array per sentence (as a model hook or a
  request produces them); the rule is ``array_min(filter(...))``, no shuffle, works on streams.

Similarity defaults to the cosine of term-frequency vectors: per row in an Arrow-batched pandas
UDF (linear, no shuffle), or relationally (``tf_cosine``: each distinct text tokenised once, the
dot product a join on (text, token) and a sum) when texts repeat a lot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paraforge.functions import text as T

# Fixed values of the reference's rules.
V3_MIN_OVERLAP = 0.05                     # C1: first candidate with overlap > 0.05, else lowest
GATE_SIM, GATE_MAX_OVERLAP = 0.75, 0.6    # C2/C3
FINAL_SIM, FINAL_LO, FINAL_HI = 0.85, 0.10, 0.55   # C4
GRAMMAR_MIN_OVERLAP = 0.5                 # C6


# ---- rules as predicates on one candidate -----------------------------------------------------

def rule_predicate(rule: str, c, original=None, sim: float | None = None, lo: float | None = None,
                   hi: float | None = None) -> Column | None:
    """The per-candidate condition of a rule; ``c`` is a struct (or row) with overlap,
    similarity and text fields. None means every candidate passes."""
    if rule == "lowest_overlap":   # C1 first pass
        return c["overlap"] > F.lit(V3_MIN_OVERLAP if lo is None else lo)
    if rule in ("meaning_gate", "or_lowest"):   # C2 / C3
        return (c["similarity"] >= F.lit(GATE_SIM if sim is None else sim)) & \
               (c["overlap"] <= F.lit(GATE_MAX_OVERLAP if hi is None else hi))
    if rule == "grounded":         # C4
        s = FINAL_SIM if sim is None else sim
        a = FINAL_LO if lo is None else lo
        b = FINAL_HI if hi is None else hi
        return (c["similarity"] >= F.lit(s)) & (c["overlap"] >= F.lit(a)) & (c["overlap"] <= F.lit(b)) & \
            ~T.introduces_new_entities(original, c["text"])
    raise ValueError(f"unknown rule {rule!r}")


def _falls_back(rule: str) -> bool:
    return rule in ("lowest_overlap", "or_lowest")


# ---- long form --------------------------------------------------------------------------------

def select_long(scored: DataFrame, rule: str, key: str = "sentence_id", **params) -> DataFrame:
    """(key, original, sel struct<overlap, gen_idx, text, similarity>) per sentence; ``sel`` is
    NULL when no candidate passes and the rule has no fallback."""
    c = F.struct("overlap", "gen_idx", "text", "similarity")
    cond = rule_predicate(rule, F.struct("overlap", "similarity", "text"), F.col("original"), **params)
    best = F.min(F.when(cond, c))
    if _falls_back(rule):
        best = F.coalesce(best, F.min(c))
    return scored.groupBy(key, "original").agg(best.alias("sel"))


def with_all_sentences(selected: DataFrame, sentences: DataFrame, key: str = "sentence_id") -> DataFrame:
    """Every sentence of (key, original) with its pick; ``sel`` is NULL where a sentence had no
    candidate at all, so that it keeps its text and counts as not confident."""
    return sentences.join(selected.select(key, "sel"), key, "left")


# ---- nested form ------------------------------------------------------------------------------

def nest_candidates(scored: DataFrame, key: str = "sentence_id") -> DataFrame:
    """(key, original, cands array<struct<overlap, gen_idx, text, similarity>>); a group is the
    n candidates of one sentence (n is the generator's fixed count)."""
    return scored.groupBy(key, "original").agg(
        F.collect_list(F.struct("overlap", "gen_idx", "text", "similarity")).alias("cands"))


def select_nested(nested: DataFrame, rule: str, cands: str = "cands", **params) -> DataFrame:
    """The same rules on an array of candidates, without a shuffle."""
    arr = F.col(cands)
    passed = F.array_min(F.filter(arr, lambda x: rule_predicate(rule, x, F.col("original"), **params)))
    if _falls_back(rule):
        passed = F.coalesce(passed, F.array_min(arr))
    return nested.withColumn("sel", passed)


def confident_or_original(selected: DataFrame, sel: str = "sel", original: str = "original") -> DataFrame:
    """The selected text and True, or the original sentence and False."""
    return selected.withColumn("paraphrased", F.coalesce(F.col(sel)["text"], F.col(original))) \
                   .withColumn("confident", F.col(sel).isNotNull())


def grammar_gate(text, corrected) -> Column:
    """A correction is trusted when its token overlap with the input is at least 0.5."""
    return T.word_overlap(text, corrected) >= F.lit(GRAMMAR_MIN_OVERLAP)


# ---- scoring (C7, H2 default) -----------------------------------------------------------------

def term_frequencies(texts: DataFrame, text: str = "text") -> DataFrame:
    """(text, tok, c): term counts of each distinct text (lower-cased whitespace tokens)."""
    return texts.select(text, F.explode(T.word_tokens(text)).alias("tok")) \
                .groupBy(text, "tok").agg(F.count(F.lit(1)).alias("c"))


def tf_cosine(pairs: DataFrame, a: str = "original", b: str = "text") -> DataFrame:
    """(a, b, similarity): cosine of term-frequency vectors for each distinct pair of texts.

    Each distinct text is tokenised once; the dot product joins the two sides' terms on
    (text, token). Texts without tokens get similarity 0.0.
    """
    pairs = pairs.select(a, b).distinct()
    texts = pairs.select(F.col(a).alias("t")).union(pairs.select(F.col(b).alias("t"))).distinct()
    tf = term_frequencies(texts, "t")
    norms = tf.groupBy("t").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("nrm"))
    left = tf.select(F.col("t").alias(a), "tok", F.col("c").alias("c1"))
    right = tf.select(F.col("t").alias(b), "tok", F.col("c").alias("c2"))
    dots = pairs.join(left, a).join(right, [b, "tok"]).groupBy(a, b).agg(F.sum(F.col("c1") * F.col("c2")).alias("dot"))
    na = norms.select(F.col("t").alias(a), F.col("nrm").alias("na"))
    nb = norms.select(F.col("t").alias(b), F.col("nrm").alias("nb"))
    out = pairs.join(dots, [a, b], "left").join(na, a, "left").join(nb, b, "left")
    sim = F.when(F.col("na").isNull() | F.col("nb").isNull() | (F.col("na") == 0) | (F.col("nb") == 0), F.lit(0.0)) \
           .otherwise(F.coalesce(F.col("dot"), F.lit(0)).cast("double") / (F.col("na") * F.col("nb")))
    return out.select(a, b, sim.alias("similarity"))


def _tf_cosine_batch(a, b):
    """Term-frequency cosine for two pandas Series of texts (Arrow batch). Term counts and norms
    are built once per distinct text in the batch (an original repeats once per candidate)."""
    import math
    from collections import Counter

    import pandas as pd

    memo = {}

    def vec(t):
        v = memo.get(t)
        if v is None:
            c = Counter((t or "").lower().split())
            v = (c, math.sqrt(sum(x * x for x in c.values())))
            memo[t] = v
        return v

    out = []
    for x, y in zip(a, b):
        (ca, na), (cb, nb) = vec(x), vec(y)
        if not na or not nb:
            out.append(0.0)
            continue
        if len(cb) < len(ca):
            ca, cb = cb, ca
        out.append(sum(v * cb.get(t, 0) for t, v in ca.items()) / (na * nb))
    return pd.Series(out, dtype="float64")


def _tf_cosine_lists(originals, candidate_lists):
    """Term-frequency cosine of each text against each of its list (Arrow batch); terms are counted once per distinct text of
    the batch."""
    import pandas as pd

    lists = [[] if c is None else list(c) for c in candidate_lists]
    flat = _tf_cosine_batch([o for o, c in zip(originals, lists) for _ in c], [x for c in lists for x in c]).tolist()
    at = 0
    out = []
    for c in lists:
        out.append(flat[at:at + len(c)])
        at += len(c)
    return pd.Series(out, dtype=object)


def scored_in_rows(df: DataFrame, tokens: str = "tokens", texts: str = "texts", text_tokens: str = "text_tokens") -> DataFrame:
    """C7 on nested candidates: (..., cands array<struct<overlap, gen_idx, text, similarity>>) for rows (original, its token set, the
    candidates' texts and token sets as arrays in order of generation). No shuffle."""
    sims = F.pandas_udf(_tf_cosine_lists, "array<double>")(F.col("original"), F.col(texts))
    shared = F.transform(text_tokens, lambda t: F.size(F.array_intersect(F.col(tokens), t)))
    staged = df.select("*", sims.alias("_pf_sims"), F.explode(F.array(shared)).alias("_pf_shared"))  # evaluated once

    def overlap(i):
        both, mine, its = F.get(F.col("_pf_shared"), i), F.size(tokens), F.size(F.get(F.col(text_tokens), i))
        return F.when((mine == 0) | (its == 0), F.lit(0.0)).otherwise(both.cast("double") / (mine + its - both).cast("double"))

    one = F.transform(texts, lambda t, i: F.struct(
        overlap(i).alias("overlap"), i.cast("int").alias("gen_idx"), t.alias("text"),
        F.coalesce(F.get(F.col("_pf_sims"), i), F.lit(0.0)).alias("similarity")))
    return staged.withColumn("cands", F.explode(F.array(one))).drop("_pf_sims", "_pf_shared", tokens, texts, text_tokens)


def tf_cosine_column(a, b) -> Column:
    """Term-frequency cosine of two text columns, per row: a vectorised (Arrow-batched) pandas
    UDF, linear in the text length, no shuffle. The relational ``tf_cosine`` computes the same
    value with joins when each distinct text should be tokenised only once."""
    udf = F.pandas_udf(_tf_cosine_batch, "double")
    return udf(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def candidate_scores(cands: DataFrame, similarity: DataFrame | None = None) -> DataFrame:
    """Attach overlap (F2) and similarity to each candidate.

    ``similarity`` may be a user table (original, text, similarity), e.g. the output of the
    ``embed_texts`` hook joined as cosine. By default the term-frequency cosine is computed in
    the row (Arrow-batched), which avoids shuffling every candidate by its text.
    """
    if similarity is not None:
        scored = cands.join(similarity, ["original", "text"], "left")
    else:
        scored = cands.withColumn("similarity", tf_cosine_column("original", "text"))
    if "original_tokens" in cands.columns and "text_tokens" in cands.columns:
        # token sets computed once per sentence upstream (e.g. the candidates fixture)
        ov = T.overlap_from_tokens("original_tokens", "text_tokens")
        scored = scored.select("*", F.explode(F.array(ov)).alias("overlap")).drop("original_tokens", "text_tokens")
    else:
        scored = scored.select("*", F.explode(F.array(T.word_overlap("original", "text"))).alias("overlap"))
    return scored.withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def cosine(u, v) -> Column:
    """cosine of two float/double arrays, in double; 0.0 when either norm is 0."""
    u = F.col(u) if isinstance(u, str) else u
    v = F.col(v) if isinstance(v, str) else v
    dot = F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    nu = F.sqrt(F.aggregate(u, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    nv = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.when((nu == 0) | (nv == 0), F.lit(0.0)).otherwise(dot / (nu * nv))


def centroid_similarity(vectors: DataFrame, vec: str = "embedding", label: str = "label", key: str = "vec_id") -> DataFrame:
    """F7 over a table: each vector's cosine to the mean vector of its label (a per-label
    aggregate joined back, no all-pairs product)."""
    dims = vectors.select(key, label, F.posexplode(vec).alias("i", "x"))
    cent = dims.groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    cvec = cent.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("cs")) \
               .select(label, F.transform("cs", lambda s: s["m"]).alias("centroid"))
    return vectors.join(cvec, label).select(key, label, cosine(vec, "centroid").alias("similarity"))
