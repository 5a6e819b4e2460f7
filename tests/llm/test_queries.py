"""Every registered training-data query runs on the smallest data and equals its SQL where it has one."""

import pytest

from notebrook.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import db, plain  # noqa: F401


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, db, name):  # noqa: F811
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in ORACLE_SQL:
        found = db.sql(ORACLE_SQL[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
