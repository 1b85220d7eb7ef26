"""Driver contract and plan checks."""

import __spark_entry__ as E


def test_registry_consistent():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 40


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["setting", "cluster", "rank", "word", "weight"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_udf_or_cartesian_in_core_plans(spark):
    sf = "/root/testdata/sf0.001"
    for name in ["segment_mintoken", "ctfidf_raw_top_words", "weighted_reps", "topic_early_stop", "hash_embed"]:
        p = _plan(E.queries()[name](spark, sf))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name
        assert "CartesianProduct" not in p, name


def test_queries_match_oracle_small(spark):
    import duckdb
    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for t in ["documents", "labels", "embeddings", "events", "part"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ["filter_dedup_stats", "segment_mintoken", "irbo_by_setting", "weighted_reps", "topic_fold",
                 "density_eps_cut"]:
        df = E.queries()[name](spark, sf)
        cols = sorted(df.columns)
        a = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in cols))
                   for r in df.collect())
        cur = con.execute(E.oracle_sql()[name])
        oc = [d[0] for d in cur.description]
        b = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in (row[oc.index(c)] for c in cols))
                   for row in cur.fetchall())
        assert a == b, name
