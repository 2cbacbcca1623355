"""Every SQL-expressible query against its DuckDB twin on the tiny fixture (sf0.001).

The same comparison as the driver's correctness gate: column names, row count
and an order-insensitive hash of the values (doubles rounded to 6 places).
The tiny fixture also exercises the edge cases (near-empty groups, single
classes) that the larger fixtures rarely hit.
"""

import pytest

from conftest import TINY
from tools.oracle_check import digest

from __spark_entry__ import oracle_sql, queries

SQL = oracle_sql()
QUERIES = queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, duck, name):
    sdf = QUERIES[name](spark, TINY)
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(SQL[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    hs, ls = digest(sdf.columns, srows)
    hd, ld = digest(dcols, drows)
    if hs != hd:
        extra = [x for x in ls if x not in set(ld)][:3]
        missing = [x for x in ld if x not in set(ls)][:3]
        pytest.fail(f"value mismatch: spark-only {extra} duck-only {missing}")


def test_every_sql_key_is_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_smoke(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert "disparate_impact" in df.columns
    assert df.count() == 1
