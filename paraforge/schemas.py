"""Explicit schemas: the supplied tables and the data model (D1-D21). No inference anywhere."""

from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Supplied tables (read with these schemas; Parquet columns outside a projection are pruned).
DOCUMENTS = _struct(("doc_id", L), ("text", S), ("lang", S), ("source", S), ("n_chars", L))
CONVERSATIONS = _struct(("conv_id", L), ("turn", L), ("role", S), ("text", S))
LABELS = _struct(("doc_id", L), ("quality", I), ("toxic", I))
EMBEDDINGS = _struct(("vec_id", L), ("embedding", T.ArrayType(T.FloatType())), ("label", I))
BENCHMARK = _struct(("item_id", L), ("text", S))
PAGES = _struct(("page_id", L), ("url", S), ("html", S))

SUPPLIED = {
    "documents": DOCUMENTS,
    "conversations": CONVERSATIONS,
    "labels": LABELS,
    "embeddings": EMBEDDINGS,
    "benchmark": BENCHMARK,
    "pages": PAGES,
}

# Labelled question pairs (label 1 = paraphrase) with an explicit source order.
LABELLED_PAIRS = _struct(("ord", L), ("question1", S), ("question2", S), ("label", I))
# Sentence pairs by split.
SENTENCE_PAIRS = _struct(("ord", L), ("sentence1", S), ("sentence2", S), ("label", I), ("split", S))
LABELLED_PAIRS_BY_SPLIT = _struct(("ord", L), ("question1", S), ("question2", S), ("label", I), ("split", S))
# D3: paraphrase lists; ``paraphrases`` holds a list literal.
PARAPHRASE_LISTS = _struct(("ord", L), ("text", S), ("paraphrases", S), ("category", S), ("source", S))
# Clusters in long form (the grouped form is never materialised: a hot cluster would be a row).
CLUSTERS = _struct(("cluster_id", L), ("pos", L), ("sentence", S))
