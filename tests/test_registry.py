import re

import __spark_entry__ as contract


def test_every_query_has_its_sql():
    queries, oracles = contract.queries(), contract.oracle_sql()
    without = set(queries) - set(oracles)
    assert set(oracles) <= set(queries)
    # only what SQL cannot express: some operators on texts, and their pipeline
    assert all(name == "pipeline" or re.match(r"op\d+_", name) for name in without)
    assert len(queries) > 100


def test_entry_runs(spark):
    rows = contract.entry(spark)
    assert rows.columns == ["start", "group", "count"]
    assert rows.count() > 0
