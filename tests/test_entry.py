"""The registered queries: every one has its SQL twin and the flagship runs."""

import __spark_entry__ as entry
from loglode.queries import base


def test_every_query_has_sql():
    assert set(base.QUERIES) == set(base.SQL)
    assert len(base.QUERIES) > 60
    assert set(base.QUERIES) <= set(entry.queries()) and set(base.SQL) <= set(entry.oracle_sql())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["item_id", "message", "path", "line_no", "line_text", "match_type", "score"]
    assert df.count() > 0
