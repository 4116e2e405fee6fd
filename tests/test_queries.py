"""Every query of the library against its DuckDB equivalent; the queries without one must run."""
import sys
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]

import pytest
from compare import oracle_rows, rows_of

from textloom import plans

QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    cols, rows = rows_of(QUERIES[name](spark, sf))
    if name in ORACLES:
        want_cols, want = oracle_rows(ORACLES[name], sf)
        assert cols == want_cols
        assert rows == want
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
