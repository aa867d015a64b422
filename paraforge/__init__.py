"""paraforge: a Spark-native engine for building, judging and serving paraphrase data.

Every core operator is a DataFrame -> DataFrame (or Column -> Column) function built from
``pyspark.sql.functions``; Python runs only inside user-supplied model hooks
(``paraforge.operators.infer``), batched through Arrow with ``mapInPandas``.

Layout
------
functions/   Column expressions: tokens, overlap, sentence split, entities, masking, cosine
sources/     readers/writers (S1-S8) and the fixtures derived from the supplied tables
operators/   relational operators: pairs, ranking/splits, similarity join, selection,
             lexicon, profiling, model hooks
plans/       composed jobs (B1-B9) and request jobs (R1-R4)
streaming/   the request jobs on an unbounded input (R5)
"""

from paraforge.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
