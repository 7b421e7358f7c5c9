import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: Loops over many small jobs take long on a laptop; they have tests of their own.
LONG = ("sel3", "sel4", "sel5", "hier2", "hier7", "hier9", "snk3_layer", "srch4_layered", "jn5", "knn1_grid", "srch1", "srch2", "nssg6", "agg10", "agg12", "rel1_sweep", "rel13", "nssg7", "rnn1", "hnsw1")
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith(LONG))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = duck.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert plain(map(tuple, df.select(*columns).collect())) == plain(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(re.fullmatch(r"[a-z0-9_]+", n) for n in entry.queries())
