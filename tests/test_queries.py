import pytest
from oracle import compare

from lodestrata import queries

SMALL = "/root/testdata/sf0.001"
ALL, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_its_sql(spark, name):
    compare(spark, ALL[name], SQL[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert ALL[name](spark, SMALL).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = ALL["region_properties"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(user_id), GreaterThan(user_id,0)]" in plan
    assert "event_type" not in plan.split("ReadSchema")[1]


def test_an_unused_feature_costs_nothing(spark):
    plan = queries._features(spark, SMALL).select("label", "area")._jdf.queryExecution().optimizedPlan().toString()
    assert "covar_pop" not in plan


def test_smoothing_runs_above_the_repartition(spark):
    plan = ALL["gaussian_smooth"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Repartition")
    assert "transform(" in above and "transform(" not in below


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_corpus_operators():
    """Their folders may be removed, with corpus_pipeline.py or without it."""
    import subprocess
    import sys
    import textwrap

    code = """
        import importlib.util as u, sys
        real, hidden = u.find_spec, {hidden}
        u.find_spec = lambda name, package=None: None if name in hidden else real(name, package)
        sys.modules |= dict.fromkeys(hidden)
        import __spark_entry__ as e
        names = set(e.queries())
        assert names and not any(n.startswith("op") or n == "pipeline" for n in names) and set(e.oracle_sql()) <= names
    """
    for hidden in (("lodestrata.llm", "lodestrata.llm.queries"), ("lodestrata.llm", "lodestrata.llm.queries", "corpus_pipeline")):
        done = subprocess.run([sys.executable, "-c", textwrap.dedent(code.format(hidden=hidden))], capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
