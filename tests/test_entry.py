import __spark_entry__ as e


def test_every_oracle_has_its_query():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 60


def test_flagship(spark):
    rows = e.entry(spark).collect()
    assert rows and all(r.exact for r in rows)
