"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from facetmatch.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(df):
    def one(v):
        if hasattr(v, "__len__") and not isinstance(v, str):
            return str([*v])
        return "null" if v is None or v != v else repr(round(float(v), 6)) if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canon(got) == canon(want)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"decision", "best_id"} <= set(df.columns)


def test_the_library_stands_without_the_text_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['facetmatch.llm'] = None; import __spark_entry__ as e; assert 'match_full' in e.queries() and 'pipeline' not in e.queries() and not any(k.startswith('op') for k in e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], check=True)
