import pytest

from spindle.plans import registry

from .compare import connect, same

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, small, name):
    same(spark, registry.queries()[name], SQL[name], small)


ODD = {
    "documents": "SELECT doc_id, CASE WHEN doc_id % 13 > 0 THEN lang END AS lang, CASE WHEN doc_id % 5 > 0 AND lang <> 'fr' THEN n_chars END AS n_chars FROM documents",
    "events": "SELECT event_id, CASE WHEN event_id % 11 > 0 THEN event_type END AS event_type, CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE WHEN event_id % 7 > 0 THEN value END AS value FROM events",
    "embeddings": "SELECT vec_id, CASE WHEN vec_id % 17 > 0 THEN embedding END AS embedding, CASE WHEN vec_id % 11 > 0 THEN label END AS label FROM embeddings",
}


@pytest.mark.parametrize("name,source", [("length_stats", "documents"), ("medians", "events"), ("tensor_stats", "embeddings")])
def test_same_rows_as_sql_with_nulls(spark, small, tmp_path, name, source):
    connect(small).execute(f"COPY ({ODD[source]}) TO '{tmp_path}/{source}.parquet' (FORMAT parquet)")
    same(spark, registry.queries()[name], SQL[name], str(tmp_path))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_rows_of_queries_without_sql(spark, small, name):
    assert registry.queries()[name](spark, small).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(registry.queries()) <= set(e.queries())


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = registry.queries()["language_scan"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(lang, [de,en])]" in plan and "ReadSchema: struct<lang:string,n_chars:bigint>" in plan


def test_nothing_joins_by_nested_loops_but_single_rows(spark, small):
    import re

    for name, f in registry.queries().items():
        plan = f(spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert "CartesianProduct" not in plan, name
        for line in plan.splitlines():
            if re.search(r"Join Cross", line):
                assert "Aggregate" in plan, name  # the other side is an aggregate of one row
