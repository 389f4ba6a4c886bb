import duckdb
import pandas as pd
import pytest

from veilmark import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    show = lambda v: "NULL" if v is None or v is pd.NaT or v != v else repr(round(float(v), 6) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, sf, duck, name):
    assert rows(catalog.queries()[name](spark, sf).toPandas()) == rows(duck.sql(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - {"drift_report", "monitor", "fit_generalization"}))
def test_rows(spark, sf, name):
    """Queries without SQL give the same number of rows twice and no row of nulls alone."""
    rows = [catalog.queries()[name](spark, sf).collect() for _ in range(2)]
    assert len(rows[0]) == len(rows[1]) and not any(all(v is None for v in r) for r in rows[0])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
