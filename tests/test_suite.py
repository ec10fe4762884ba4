"""Every registered query against its SQL on small tables."""

import duckdb
import pytest

from nestq.plans import suite

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype.kind in "iuf":
            df[c] = df[c].astype(float).round(4)
    df = df.astype(object).where(df.notna(), None)
    return sorted(map(repr, df.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", list(suite.QUERIES))
def test_query(spark, duck, data, name):
    mine, theirs = suite.QUERIES[name](spark, data).toPandas(), duck.execute(suite.ORACLE[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(suite.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


WHOLE = "view_alias_entity rel_many_to_many rel_self_children rel_recursive_children rel_recursive_levels rel_recursive_where rel_recursive_parents through_entity".split()


@pytest.mark.parametrize("name", WHOLE)
def test_whole_query_has_no_subset(duck, name):
    """Each relation, recursion and view also runs over all rows, of which the filtered query has a part."""
    part, whole = (rows(duck.execute(suite.ORACLE[n]).df()) for n in (name, f"{name}_all"))
    assert len(whole) >= len(part) > 0 or name == "rel_recursive_parents"
    assert whole and set(part) <= set(whole)
