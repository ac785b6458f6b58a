"""Every registered query runs, and matches its SQL oracle where it has one."""
import pytest

import __spark_entry__ as entry
from tools.check_oracles import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["scored_rows"] > 0 and row["last_updated_utc"].endswith("Z")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    result = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in result.collect()]
    assert rows
    if name in ORACLES:
        duck = connect(FOLDER).execute(ORACLES[name])
        columns = [d[0] for d in duck.description]
        problem = compare(result.columns, rows, columns, duck.fetchall())
        assert problem is None, problem
