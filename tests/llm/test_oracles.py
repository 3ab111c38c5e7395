"""The operators' queries against their SQL twins on the small tables."""

import duckdb
import pytest

from tunegrain.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = con.execute(ORACLES[name])
    columns = sorted(d[0] for d in result.description)
    want = result.df()[columns].astype(object)
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == columns
    assert sorted(map(str, rows_of(got, columns))) == sorted(map(str, rows_of_pandas(want)))


def rows_of(df, columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def rows_of_pandas(frame):
    return [tuple(None if v is None or v != v else v for v in r) for r in frame.itertuples(index=False)]
