"""Every query of the library against DuckDB on the small tables, or its number of rows where SQL cannot express it."""

import pytest
from conftest import SF, canonical

from standmill.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = canonical(found.select(*columns).collect())
    if name not in SQL:
        assert rows
        return
    wanted = duck.execute(SQL[name])
    names = [d[0] for d in wanted.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == canonical([[r[i] for i in order] for r in wanted.fetchall()])


def test_every_query_of_the_oracle_exists():
    assert set(SQL) <= set(QUERIES)


def test_flagship(spark):
    rows = catalog.flagship(spark, SF).collect()
    heights = [r.height_m for r in rows]
    assert rows and heights == sorted(heights, reverse=True)
