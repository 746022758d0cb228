import pytest

import __spark_entry__
from faultline.plans import relational

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"


def _rows(rows):
    return sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["shortlisted_candidates", "task_key", "markov_surprisal", "plateau_islands"])
def test_plans_agree_with_their_sql(spark, name):
    con = duckdb.connect()
    for t in relational.TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, FOLDER)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    assert df.columns == want.columns and _rows(map(tuple, df.collect())) == _rows(want.fetchall())
