"""Every star-schema query against its SQL oracle."""

import math

import duckdb
import pandas as pd
import pytest

from kinweave.plans import kin, shapes, star

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 6) if isinstance(x, float) else int(x) if hasattr(x, "__index__") else str(x)


def rows(df):
    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


QUERIES, ORACLE = star.QUERIES | kin.QUERIES | shapes.QUERIES, star.ORACLE | kin.ORACLE | shapes.ORACLE


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_partner_chain_is_a_longest_path(spark):
    (row,) = star.QUERIES["partner_chain"](spark, SF).collect()
    path = [int(x) for x in row.path.split(",")]
    assert len(path) == row.length == len(set(path))
    assert all(a // 2 == b or b // 2 == a for a, b in zip(path, path[1:], strict=False))


def test_line_chain_is_whole(spark, duck):
    """All 150 customers, of which a cap left 100."""
    (row,) = shapes.QUERIES["line_chain"](spark, SF).collect()
    everyone = [k for (k,) in duck.execute("SELECT c_custkey FROM customer ORDER BY 1").fetchall()]
    assert sorted(map(int, row.path.split(","))) == everyone and row.length == len(everyone) == 150


def test_seconds_of_anchored_clusters_are_rounded_as_in_the_sql(spark, tmp_path):
    """Half seconds, after and before 1970, and fractions that rounding takes over or under the reach of an hour."""
    at = ["2024-01-01 00:00:00.5", "2024-01-01 01:00:00.6", "2024-01-01 04:00:00.4", "2024-01-01 05:00:00.7", "2024-01-01 08:00:01.5", "2024-01-01 09:00:02.499999", "1969-12-31 20:59:58.5", "1969-12-31 21:59:58.9", "1969-12-31 23:59:59.2", "1970-01-01 00:59:59.5"]
    values = ", ".join(f"({k // 2}::BIGINT, TIMESTAMP '{x}')" for k, x in enumerate(at))
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM (VALUES {values}) v(user_id, ts)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    theirs = con.execute(ORACLE["anchored_clusters"]).df()
    assert rows(QUERIES["anchored_clusters"](spark, str(tmp_path)).toPandas()) == rows(theirs) == [(1, 2), (8, 1)]


def test_coordinates_are_read_once(spark):
    """A record's two blocks and four coordinates, however often the distance mentions them."""
    plan = QUERIES["tree_migration_distances"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 6
