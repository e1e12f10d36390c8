import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["city", "skill", "count", "city_postings", "percentage", "rank"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 90


def test_flagship_plan_is_native(spark):
    from postlens.plans.flagship import skill_demand_by_city
    from postlens.plans.q_clean import cleaned

    plan = skill_demand_by_city(cleaned(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "PushedFilters" in plan or "FileScan" in plan


def test_matching_plan_has_no_cartesian(spark):
    qs = E.queries()
    plan = qs["profile_matches"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_package_functions_ship_by_value():
    """Functions that run in tasks must not need the package on the executors' path."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from postlens.operators.nlp import quadratic_cells

    blob = cloudpickle.dumps(quadratic_cells)
    code = "import sys, pickle; f = pickle.loads(bytes.fromhex(sys.argv[1])); assert 'postlens' not in sys.modules; print(f.__name__)"
    out = subprocess.run([sys.executable, "-c", code, blob.hex()], cwd="/", env={}, capture_output=True, text=True)
    assert out.stdout.strip() == "quadratic_cells", out.stderr
