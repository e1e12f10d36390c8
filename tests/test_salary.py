import random

from pyspark.sql import functions as F

from postlens.functions.ordinals import ordinals
from postlens.operators import salary as S
from tests.conftest import JOBS


def _pred(spark, **job):
    base = dict(title="Data Scientist", location="Bangalore, Karnataka", skills="python", company_size="Medium")
    base.update(job)
    df = spark.createDataFrame([base])
    return S.heuristic_salary(df).collect()[0]


def test_canonical_roles(spark):
    df = spark.createDataFrame([("Senior Data Scientist",), ("HTML developer",), ("Staff SWE",), ("Chef",)], "title string")
    got = [r[0] for r in df.select(S.salary_role_col(F.col("title"))).collect()]
    # table order shadows 'senior data scientist'; 'ml' matches inside 'html'
    assert got == ["data scientist", "machine learning engineer", "software engineer", "software engineer"]


def test_heuristic_relations(spark):
    assert _pred(spark, title="Senior Data Scientist")["salary_avg_pred"] > _pred(spark, title="Junior Data Scientist")["salary_avg_pred"]
    assert _pred(spark, location="Bangalore")["salary_avg_pred"] > _pred(spark, location="Kolkata")["salary_avg_pred"]
    a, b = _pred(spark, skills="python"), _pred(spark, skills="aws,docker,kubernetes")
    assert b["salary_avg_pred"] > a["salary_avg_pred"] and b["salary_min_pred"] == a["salary_min_pred"]
    r = _pred(spark)
    # 12..25 LPA base, Bangalore 1.15, Medium 0.95, level 2
    assert r["salary_min_pred"] == round(12 * 1.15 * 0.95, 2)
    assert r["salary_avg_pred"] == round((12 + 25) / 2 * 1.15 * 0.95, 2)


def test_target_and_encoding(spark):
    df = spark.createDataFrame([(None, 10.0, 20.0), (0.0, 8.0, None), (None, None, None), (15.0, 1.0, 1.0)],
                               "salary_avg double, salary_min double, salary_max double")
    got = [r[0] for r in df.select(S.salary_target_col(F.col("salary_avg"), F.col("salary_min"), F.col("salary_max"))).collect()]
    assert got == [15.0, 8.0, None, 15.0]
    train = spark.createDataFrame([("b",), ("a",), ("c",)], "k string")
    enc = S.encode(spark.createDataFrame([("c",), ("z",)], "k string"), train, "k", "e")
    assert sorted((r["k"], r["e"]) for r in enc.collect()) == [("c", 2), ("z", -1)]


def test_market_grouping_sets(spark):
    df = spark.createDataFrame([dict(title="Data Scientist", location="Pune", skills="", company_size="Large"),
                                dict(title="Data Analyst", location="Pune", skills="", company_size="Large")])
    out = S.salary_market(S.heuristic_salary(df)).collect()
    levels = sorted(r["level"] for r in out)
    assert levels == ["location", "overall", "role", "role"]
    overall = [r for r in out if r["level"] == "overall"][0]
    assert overall["count"] == 2


def _postings(spark, n, paid=True):
    rows = [dict(job_id=str(k), title=["Data Scientist", "Data Analyst", "DevOps Engineer"][k % 3], location=["Pune", "Bangalore"][k % 2], company="c",
                 skills="python,sql" if k % 4 else "aws", company_size="Medium", description="", salary_min=float(5 + 10 * (k % 3) + k % 2) if paid else None,
                 salary_max=float(9 + 10 * (k % 3) + k % 2) if paid else None) for k in range(n)]
    return spark.createDataFrame(rows, "job_id string, title string, location string, company string, skills string, company_size string, "
                                       "description string, salary_min double, salary_max double")


def test_synthetic_labels_do_not_depend_on_partitions(spark):
    df = _postings(spark, 40, paid=False)
    a, b = ({r.job_id: r.target for r in S.synthetic_labels(df.repartition(n)).collect()} for n in (1, 4))
    assert a == b and a != {r.job_id: r.target for r in S.synthetic_labels(df, seed=7).collect()}
    base = {r.job_id: r.salary_avg_pred for r in S.heuristic_salary(df).collect()}
    assert all(0.9 * base[k] - 0.01 <= v <= 1.1 * base[k] + 0.01 for k, v in a.items()) and len(set(a.values())) > 10


def test_model_modes_save_and_load(spark, tmp_path):
    assert S.train_model(_postings(spark, 0))[2]["mode"] == "heuristic"
    few = _postings(spark, 4)  # under five labels: synthetic ones are added
    assert S.train_model(few)[2]["samples"] == 8
    df = _postings(spark, 60)
    model, train, m = S.train_model(df, model_path=str(tmp_path / "m"))
    assert (m["mode"], m["samples"]) == ("ml", 60) and m["mae_lpa"] < m["mae_of_mean"]
    key = lambda d: sorted((r.job_id, r.salary_avg_pred, r.confidence, r.method) for r in d.collect())
    assert key(S.predict(df, model, train)) == key(S.predict(df, S.load_model(str(tmp_path / "m")), train))
    assert {r.method for r in S.predict(df).collect()} == {"heuristic"}
    assert "GBTRegressor" in spark.read.text(str(tmp_path / "m_metadata")).first()[0]


def test_units_and_longest_role(spark):
    import pytest

    df = spark.createDataFrame([(1_200_000.0, "senior data scientist")], "x double, title string")
    assert df.select(S.to_lpa(F.col("x"), "inr_per_year")).first()[0] == pytest.approx(12.0)
    with pytest.raises(ValueError):
        S.to_lpa(F.col("x"), "euro")
    assert df.select(S.salary_role_col(F.col("title"), longest_first=True)).first()[0] == "senior data scientist"


def test_ordinals_are_dense_ranks_without_one_task(spark):
    rng = random.Random(2)
    words = [None] + ["".join(rng.choice("abcé日Z") for _ in range(rng.randrange(1, 5))) for _ in range(3000)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r["w"]: r["pos"] for r in ordinals(df, "w", "pos").collect()}
    assert got == {w: i for i, w in enumerate(sorted({w for w in words if w}, key=lambda x: x.encode()))}
    jobs = spark.createDataFrame(JOBS)
    plan = S.build_features(S.with_salary_inputs(jobs), S.with_salary_inputs(jobs))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [" not in plan and "dense_rank" not in plan
    assert ordinals(df.limit(0), "w", "pos").count() == 0


def test_encoders_with_a_hot_city(spark):
    """Half of the rows share a city; each row meets its one class, whether broadcast or shuffled."""
    rows = spark.range(20_000).selectExpr("if(id % 2 = 0, 'hot', concat('city', id % 1000)) as k")
    want = {k: i for i, k in enumerate(sorted({"hot"} | {f"city{i}" for i in range(1, 1000, 2)}))}
    for size in ("10m", "-1"):
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
        got = S.encode(rows, rows, "k", "e").groupBy("k", "e").count().collect()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        assert {r["k"]: r["e"] for r in got} == want and {r["k"]: r["count"] for r in got}["hot"] == 10_000
