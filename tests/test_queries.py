"""Every registered query runs; those with SQL give the rows that DuckDB gives."""

import duckdb
import pytest

from billsift import queries_admission, queries_captures, queries_discovery, queries_ingest, queries_rules, queries_store, queries_streams, queries_tracing, queries_values  # noqa: F401 (they register their queries)
from billsift.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


def same(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name in SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        found = con.execute(SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        assert same(rows, df.columns) == same(found.fetchall(), names)
