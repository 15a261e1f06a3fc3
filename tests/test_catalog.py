"""Every registered query against its SQL."""

import pytest
from conftest import DATA, check_same
from folioframe.plans import catalog

SQL = catalog.oracle_sql()
#: The 0.001 tables have none of these; the 0.01 tables do.
MAY_BE_EMPTY = {"outline_duplicates"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    rows = check_same(catalog.queries()[name](spark, str(DATA)), duck, SQL[name])
    assert rows > 0 or name in MAY_BE_EMPTY


def test_names():
    assert set(SQL) <= set(catalog.queries())


KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def test_types(spark, duck):
    for name, sql in SQL.items():
        ours = {c: KINDS.get(t) for c, t in catalog.queries()[name](spark, str(DATA)).dtypes}
        assert ours == {x[0]: str(x[1]) for x in duck.execute(f"SELECT * FROM ({sql}) LIMIT 0").description}, name
