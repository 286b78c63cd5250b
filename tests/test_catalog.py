"""Every registered query against its checking SQL in DuckDB, on whole tables."""

import glob
import os

import duckdb
import pytest

from roadpulse.catalog import all_oracles, all_queries
from tests.conftest import SF_DIR

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _sorted_rows(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple("~" if r[i] is None else repr(r[i] + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


#: What a model learned on the given classes; the tests of the models hold these against direct computations.
WITHOUT_SQL = {"m2_predictions", "m3_loss_by_round", "m5_predictions"}


def test_all_others_have_sql():
    assert set(ORACLES) == set(QUERIES) - WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    cur = duck.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(columns) == sorted(got.columns)
    assert _sorted_rows(got.collect(), got.columns) == _sorted_rows(want, columns)
