import duckdb
import pytest

from quillspark.plans import catalog

from .oracle import SF, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_duckdb(spark, name):
    assert spark_rows(catalog.QUERIES[name](spark, SF)) == duck_rows(catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_same_rows_again(spark, name):
    """No SQL says what these give; tests of their functions do. Here they give rows, of which most are filled, and the same
    ones from other partitions."""
    first = spark_rows(catalog.QUERIES[name](spark, SF))
    assert first[1] and sum(v not in ("None", "", "[]") for r in first[1] for v in r) > len(first[1]) / 2
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert spark_rows(catalog.QUERIES[name](spark, SF)) == first
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_approximations_are_close(spark):
    """Distinct counts within five standard errors of two in a hundred, medians within one rank in ten thousand."""
    want = {r[0]: r[1:] for r in duckdb.sql(f"SELECT event_type, count(DISTINCT user_id), list_sort(list(value)) FROM '{SF}/events.parquet' GROUP BY 1").fetchall()}
    got = {r.event_type: r for r in catalog.QUERIES["i18_approximate"](spark, SF).collect()}
    assert set(got) == set(want)
    for kind, (users, values) in want.items():
        assert abs(got[kind].users - users) <= max(1, 0.1 * users)
        assert sum(v < got[kind].median for v in values) <= len(values) / 2 <= sum(v <= got[kind].median for v in values) + 1
