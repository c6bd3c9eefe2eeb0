"""Every registered query against its DuckDB SQL on the same tables."""

import decimal

import pytest

from shutterlake.plans.catalogue import ORACLES, QUERIES
from tests.conftest import DATA


def plain(value):
    return int(value) if isinstance(value, decimal.Decimal) else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(plain(row[i])) for i in order) for row in rows)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    expected = table(columns, result.fetchall())
    assert expected, "a check over no rows proves nothing"
    assert table(df.columns, df.collect()) == expected


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
