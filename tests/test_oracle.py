"""Every query that has SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from loupe import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([r[i] for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_what_sql_gives(spark, sql, name):
    got = queries.QUERIES[name](spark, FOLDER)
    want = sql.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, map(tuple, got.collect())) == rows(names, want.fetchall())


def test_every_prepared_query_has_a_row():
    from loupe.grammar import registry, samples

    for language in registry.LANGUAGES:
        assert set(registry.language(language).QUERIES) <= set(samples.EXPECTED[language])
        assert {x.partition("~")[0] for x in samples.EXPECTED[language] if "~" in x} == set(getattr(registry.language(language), "NAMED", {}))
