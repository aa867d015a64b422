"""Request jobs (R1, R2, R4): the reference's POST routes re-aimed as DataFrame functions over a request table, static or
streaming.

The work on one text is row-local: a hook call for the distinct texts of an Arrow batch, then candidates as an array in the row, scored
and picked by array expressions. A static table is answered once per distinct text and joined back; a stream is answered row by
row, as its texts cannot be made distinct without state. R2 works on sentences, which a static table unrolls and a stream keeps nested
(``paraforge.streaming`` runs the streams).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraforge.functions import text as T
from paraforge.operators import infer as H
from paraforge.operators import select as C

CANDIDATES = "array<struct<gen_idx:int,text:string,similarity:double>>"
# A slice of an Arrow batch that is answered at once holds about so many characters, one row at least.
SLICE_CHARS = 100_000


def _slices(pdf, text: str, limit: int):
    """The rows of an Arrow batch in slices of bounded text: candidates are several times their text, and Python's objects
    several times that."""
    chars = pdf[text].str.len().fillna(0).cumsum() // limit
    for _, part in pdf.groupby(chars, sort=True):
        yield part


def _candidates_of(texts, fn) -> dict:
    """text -> its candidates in order of generation, with their term-frequency cosine to the text."""
    import pandas as pd

    if not len(texts):
        return {}
    gen = fn(pd.DataFrame({"text": texts}))
    by_text: dict = {}
    sims = C._tf_cosine_batch(gen["text"], gen["candidate"])
    for t, g, c, s in zip(gen["text"], gen["gen_idx"], gen["candidate"], sims):
        by_text.setdefault(t, []).append({"gen_idx": int(g), "text": c, "similarity": float(s)})
    return {t: sorted(found, key=lambda d: d["gen_idx"]) for t, found in by_text.items()}


def _once_per_text(requests: DataFrame, text: str, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``requests`` with the columns that ``answer`` adds to a table with the column ``original``: for each distinct text of a static
    table, for each row of a stream."""
    rows = requests.withColumn("original", F.col(text))
    if requests.isStreaming:
        return answer(rows)
    found = answer(rows.select("original").filter(F.col("original").isNotNull()).distinct())
    return rows.join(found, "original", "left")


def _generated(df: DataFrame, generator: Callable) -> DataFrame:
    """``df`` with the generator's candidates of ``original`` and their similarity as an array ``cands``; a worker holds the candidates
    of one slice of a batch at a time."""
    get, limit = H.hook(generator), SLICE_CHARS
    names = df.columns

    def run(batches):
        fn = get()
        for batch in batches:
            for pdf in _slices(batch, "original", limit):
                by_text = _candidates_of(pdf["original"].dropna().unique(), fn)
                yield pdf.assign(cands=[by_text.get(t, []) for t in pdf["original"]])[[*names, "cands"]]

    return df.mapInPandas(run, ", ".join([*(_typed(df, c) for c in names), f"cands {CANDIDATES}"]))


def _picked(df: DataFrame, generator: Callable, **rule_params) -> DataFrame:
    """``df`` with paraphrased and confident for its column ``original``: H1 -> F2 and cosine -> C4 -> C5, all in the row."""
    nested = _generated(df, generator)
    scored = F.transform("cands", lambda c: F.struct(
        T.word_overlap(F.col("original"), c["text"]).alias("overlap"), c["gen_idx"].alias("gen_idx"),
        c["text"].alias("text"), c["similarity"].alias("similarity")))
    picked = C.select_nested(nested.withColumn("scored", scored), "grounded", cands="scored", **rule_params)
    return C.confident_or_original(picked).select(*df.columns, "paraphrased", "confident")


def paraphrase_requests(requests: DataFrame, generator: Callable, key: str = "request_id", text: str = "text",
                        embedder: Callable | None = None, **rule_params) -> DataFrame:
    """Text -> H1 candidates -> C7 scores -> C4 grounded pick -> C5.

    Output (key, original, paraphrased, confident). Similarity is the term-frequency cosine
    unless an embedder hook is given (static tables only: vectors are joined). Requests without candidates keep their text, not
    confident.
    """
    if embedder is None:
        out = _once_per_text(requests.select(key, text), text, lambda df: _picked(df, generator, **rule_params))
        return out.select(key, "original", F.coalesce("paraphrased", "original").alias("paraphrased"),
                          F.coalesce("confident", F.lit(False)).alias("confident"))
    reqs = requests.select(key, F.col(text).alias("original"))
    cands = H.generate_candidates(reqs, generator, key, "original")
    texts = cands.select(F.col("original").alias("text")).union(cands.select("text"))
    scored = C.candidate_scores(cands, H.embedding_similarity(cands, H.embed_texts(texts, embedder)))
    sel = C.select_long(scored, "grounded", key=key, **rule_params).drop("original")
    out = C.confident_or_original(reqs.join(sel, key, "left"))
    return out.select(key, "original", "paraphrased", "confident")


def paragraph_requests(requests: DataFrame, generator: Callable, key: str = "request_id", text: str = "text",
                       **rule_params) -> DataFrame:
    """R2: F3 -> per-sentence R1 -> A9. Output (key, original, paraphrased, sentences) where
    ``sentences`` is array<struct<original, paraphrased, confident>> in sentence order. On a static table each distinct
    sentence is answered once and joined back; the regroup is by request: one group is one request's sentences."""
    if requests.isStreaming:
        return _paragraphs_in_rows(requests, generator, key, text, **rule_params)
    sents = requests.select(key, F.posexplode(T.split_sentences(text)).alias("pos", "original"))
    found = _picked(sents.select("original").distinct(), generator, **rule_params)
    grouped = sents.join(found, "original").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(
        "pos", "original", "paraphrased", "confident"))).alias("_pf_s"))
    grouped = grouped.select(key, F.transform("_pf_s", lambda s: F.struct(
        s["original"].alias("original"), s["paraphrased"].alias("paraphrased"),
        s["confident"].alias("confident"))).alias("sentences"))
    out = requests.select(key, F.col(text).alias("original")).join(grouped, key, "left")
    out = out.withColumn("sentences", F.coalesce("sentences", F.array().cast(H.SENTENCE_RESULT)))
    return out.select(key, "original",
                      F.array_join(F.transform("sentences", lambda s: s["paraphrased"]), " ").alias("paraphrased"),
                      "sentences")


def _corrected(df: DataFrame, corrector: Callable) -> DataFrame:
    """``df`` with corrected and confident for its column ``original``; blank texts skip the hook (P10)."""
    get = H.hook(corrector)
    names = df.columns

    def run(batches):
        import pandas as pd

        fn = get()
        for pdf in batches:
            todo, by_text = pdf.loc[~pdf["_pf_blank"], "original"].unique(), {}
            if len(todo):  # the answer is found by text: a hook may reorder or drop rows
                res = fn(pd.DataFrame({"text": todo}))
                by_text = dict(zip(res["text"], res["corrected"]))
            corrected = [(t or "") if b else by_text.get(t) for t, b in zip(pdf["original"], pdf["_pf_blank"])]
            yield pdf.assign(corrected=pd.Series(corrected, index=pdf.index, dtype=object))[[*names, "_pf_blank", "corrected"]]

    staged = df.withColumn("_pf_blank", T.is_blank("original"))
    fixed = staged.mapInPandas(run, ", ".join([*(_typed(df, c) for c in names), "_pf_blank boolean", "corrected string"]))
    confident = F.when(F.col("_pf_blank"), F.lit(False)).otherwise(C.grammar_gate(F.col("original"), F.col("corrected")))
    return fixed.select(*names, "corrected", confident.alias("confident"))


def grammar_requests(requests: DataFrame, corrector: Callable, key: str = "request_id", text: str = "text") -> DataFrame:
    """P10 -> H3 -> C6. Output (key, original, corrected, confident)."""
    out = _once_per_text(requests.select(key, text), text, lambda df: _corrected(df, corrector))
    none = F.col("original").isNull()
    return out.select(key, "original", F.when(none, F.lit("")).otherwise(F.col("corrected")).alias("corrected"),
                      F.when(none, F.lit(False)).otherwise(F.col("confident")).alias("confident"))


def _typed(df: DataFrame, name: str) -> str:
    """The column's name and type for a schema string."""
    return f"{name} {df.schema[name].dataType.simpleString()}"


def _paragraphs_in_rows(requests: DataFrame, generator: Callable, key: str, text: str, **rule_params) -> DataFrame:
    """R2 with no state: each request keeps its sentences and their candidates nested; scoring, the grounded pick and
    the rejoin (A9) are row-local."""

    get, limit = H.hook(generator), SLICE_CHARS

    def run(batches):
        import pandas as pd

        fn = get()
        for batch in batches:
            for pdf in _slices(batch, "original", limit):
                sent_lists = [list(s) if s is not None else [] for s in pdf["sents"]]
                by_text = _candidates_of(sorted({s for ss in sent_lists for s in ss}), fn)
                nested = [[{"sentence": s, "cands": by_text.get(s, [])} for s in ss] for ss in sent_lists]
                yield pd.DataFrame({key: pdf[key], "original": pdf["original"], "sents": pd.Series(nested, index=pdf.index, dtype=object)})

    staged = requests.select(key, F.col(text).alias("original"), T.split_sentences(text).alias("sents"))
    nested = staged.mapInPandas(run, f"{_typed(requests, key)}, original string, sents array<struct<sentence:string,cands:{CANDIDATES}>>")

    def per_sentence(s):
        scored = F.transform(s["cands"], lambda c: F.struct(
            T.word_overlap(s["sentence"], c["text"]).alias("overlap"), c["gen_idx"].alias("gen_idx"),
            c["text"].alias("text"), c["similarity"].alias("similarity")))
        sel = F.array_min(F.filter(scored, lambda x: C.rule_predicate("grounded", x, s["sentence"], **rule_params)))
        return F.struct(s["sentence"].alias("original"), F.coalesce(sel["text"], s["sentence"]).alias("paraphrased"),
                        sel.isNotNull().alias("confident"))

    results = nested.withColumn("sentences", F.transform("sents", per_sentence))
    return results.select(key, "original",
                          F.array_join(F.transform("sentences", lambda r: r["paraphrased"]), " ").alias("paraphrased"),
                          "sentences")
