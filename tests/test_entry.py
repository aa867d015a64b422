import duckdb
import pytest

import __spark_entry__ as E

SF_SMALL = "/root/testdata/sf0.001"
TABLES = ["documents", "conversations", "labels", "embeddings", "benchmark", "pages"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"cluster_id", "pos1", "pos2", "sentence1", "sentence2", "overlap"}
    assert df.count() >= 0


def test_registry_consistent():
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 60


@pytest.mark.parametrize("name", ["mine_cluster_pairs", "build_pairs_v6", "select_grounded", "contextual_synonyms",
                                  "paragraph_requests", "overlap_report"])
def test_oracle_agrees_on_small_data(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    od = con.sql(E.oracle_sql()[name]).df()
    assert sorted(sp.columns) == sorted(od.columns)
    cols = sorted(sp.columns)

    def norm(df):
        out = []
        for r in df[cols].itertuples(index=False):
            out.append(tuple((None if v != v else round(v, 6)) if isinstance(v, float) else v for v in r))
        return sorted(out, key=repr)

    assert norm(sp) == norm(od)


def test_stream_equals_batch(spark):
    batch = {tuple(r) for r in E.queries()["grammar_requests"](spark, SF_SMALL).collect()}
    stream = {tuple(r) for r in E.queries()["stream_requests"](spark, SF_SMALL).collect()}
    assert batch == stream and len(batch) > 0


@pytest.mark.parametrize("batch,stream", [("paraphrase_requests", "stream_paraphrase_requests"),
                                          ("paragraph_requests", "stream_paragraph_requests")])
def test_stream_jobs_equal_batch(spark, batch, stream):
    qs = E.queries()
    b = {tuple(r) for r in qs[batch](spark, SF_SMALL).select(*_cols(stream)).collect()}
    s = {tuple(r) for r in qs[stream](spark, SF_SMALL).collect()}
    assert b == s and len(b) > 0


def _cols(name):
    return {"stream_paraphrase_requests": ["request_id", "original", "paraphrased", "confident"],
            "stream_paragraph_requests": ["request_id", "original", "paraphrased", "n_sentences", "n_confident"]}[name]
