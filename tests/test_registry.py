import re

import __spark_entry__ as entry
from runlens import catalog

DIR = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 120
    assert not [n for n in catalog.load().QUERIES if re.match(r"op\d", n)]


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[:2] == ["model", "variant"]


def test_scoreboard_reads_only_what_it_needs(spark):
    plan = entry.queries()["scoreboard"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "l_shipdate" not in plan and "l_tax" not in plan


def test_joins_have_keys(spark):
    for n in ("scoreboard", "ledger_outcomes", "author_surface", "host_load_summary", "container_owners", "archive_mismatches"):
        plan = entry.queries()[n](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan, n
