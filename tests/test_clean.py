from pyspark.sql import functions as F

from postlens.functions.text import title_case
from postlens.operators import clean as C
from tests.conftest import rows


def _one(spark, fn, value, schema="v string"):
    df = spark.createDataFrame([(value,)], schema)
    return df.select(fn(F.col("v")).alias("o")).collect()[0]["o"]


def test_title_examples(spark):
    cases = {"Senior Data Scientist": "Data Scientist", "Software Developer": "Software Engineer",
             "Site Reliability Engineer": "DevOps Engineer", "  chief happiness officer  ": "Chief Happiness Officer",
             "SDE-2": "Software Engineer", "Tech Lead": "Engineering Manager", None: "Unknown"}
    for raw, want in cases.items():
        assert _one(spark, C.standardize_title_col, raw) == want, raw


def test_title_case_matches_python(spark):
    samples = ["c++/java dev", "(us-east) ops", "o'neil", "3d artist", "émile zola", "ML  engineer", "", "x"]
    df = spark.createDataFrame([(s,) for s in samples], "v string")
    got = {r["v"]: r["o"] for r in df.select("v", title_case("v").alias("o")).collect()}
    for s in samples:
        assert got[s] == s.title(), s


def test_normalize_skill(spark):
    assert _one(spark, C.normalize_skill_col, "powerbi") == "power bi"
    assert _one(spark, C.normalize_skill_col, "tensor flow") == "tensorflow"
    assert _one(spark, C.normalize_skill_col, " Obscure_Tool ") == "obscure_tool"


def test_parse_skills_forms(spark):
    cases = [("py, Pandas ,sklearn", ["python", "pandas", "scikit-learn"]),
             ("['docker','k8s']", ["docker", "kubernetes"]),
             ('["docker","k8s","terraform"]', ["docker", "kubernetes", "terraform"]),
             ("", []), (None, []), ("python,,sql, ", ["python", "sql"]), ("a,a", ["a", "a"])]
    df = spark.createDataFrame(cases, "v string, want array<string>")
    for r in C.parse_skills(df, "v", "o").collect():
        assert r["o"] == r["want"], r["v"]


def test_location(spark):
    cases = [("Remote - Anywhere", "Remote", "USA"), ("San Francisco, CA", "San Francisco", "CA"),
             ("NYC, NY", "New York", "NY"), (None, "Unknown", "Unknown"), ("Pune", "Pune", "Unknown"),
             ("Bangalore, Karnataka", "Bangalore", "KA"), ("kolkata, west bengal", "Kolkata", "WE")]
    df = spark.createDataFrame([(c[0],) for c in cases], "location string")
    got = {r[0]: (r[1], r[2]) for r in rows(C.standardize_location(df), "location", "city_standardized",
                                              "state_standardized")}
    for loc, city, state in cases:
        assert got[loc] == (city, state), loc


def test_state_map_flag(spark):
    df = spark.createDataFrame([("Austin, Texas",)], "location string")
    assert rows(C.standardize_location(df), "state_standardized") == [("TE",)]
    assert rows(C.standardize_location(df, state_map=True), "state_standardized") == [("TX",)]


def test_remove_duplicates_keeps_first_in_order(spark):
    df = spark.createDataFrame([("Data Scientist", "Acme", "SF", 2), ("Data Scientist", "Acme", "SF", 1),
                                ("Engineer", "Acme", "SF", 3)], "title_standardized string, company string, city string, n int")
    out = C.remove_duplicates(df, ["n"])
    assert sorted(rows(out, "title_standardized", "n")) == [("Data Scientist", 1), ("Engineer", 3)]


def test_role_category_quirks(spark):
    assert _one(spark, C.role_category_col, "ML Engineer") == "Other"
    assert _one(spark, C.role_category_col, "Maintenance Lead") == "Data Science & ML"  # 'ai' inside
    assert _one(spark, C.role_category_col, "Cloud Architect") == "DevOps & Cloud"


def test_clean_pipeline_and_report(spark):
    from tests.conftest import JOBS

    df = spark.createDataFrame(JOBS + [dict(JOBS[0], job_id="job_004")])
    out = C.clean_postings(df)
    assert out.count() == 3
    rep = C.data_quality_report(out).collect()[0]
    assert rep["total_records"] == 3 and rep["duplicate_count"] == 0 and rep["jobs_with_no_skills"] == 0
    summary = dict(rows(C.cleaned_summary(out), "metric", "value"))
    assert summary["Total Jobs"] == "3"


def test_empty_input(spark):
    from tests.conftest import JOBS

    df = spark.createDataFrame(JOBS).limit(0)
    assert C.clean_postings(df).count() == 0


def test_dedup_carries_input_columns_alone(spark):
    """What is derived from the winner's columns is derived after the dedup, with the same rows and column order as before it."""
    cols = ["job_id", "title", "company", "location", "skills"]
    data = [(f"j{i % 7}", ["Sr. data scientist", "SDE", None][i % 3], ["Acme", None][i % 2], [None, "Pune, Maharashtra", "Remote", "nyc , New York"][i % 4],
             [None, "py, SQL", '["k8s"]', ""][i * 7 % 4]) for i in range(60)]
    df = spark.createDataFrame(data, ", ".join(f"{c} string" for c in cols))
    for frame in (df, df.withColumn("city", F.lower("location"))):
        out = C.clean_postings(frame)
        early = C.fill_missing(C.standardize_location(C.parse_skills(C.standardize_title(frame))))
        early = C.with_role_category(C.remove_duplicates(early, frame.columns)).withColumn("skill_count", F.size("skills_normalized").cast("bigint"))
        assert out.columns == early.columns
        assert sorted(map(str, out.collect())) == sorted(map(str, early.collect()))
        exchanged = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate" in x]
        assert exchanged and not any("skills_normalized" in x or "state_standardized" in x for x in exchanged)


def test_columns_that_are_read_come_from_the_same_row(spark):
    import random

    rng = random.Random(3)
    cols = ["job_id", "title", "company", "location", "description", "skills", "pay"]
    rows = [(rng.choice(["1", "2", None]), rng.choice(["Data Analyst", "data analyst II", None]), rng.choice(["A", None]), rng.choice(["NYC, NY", "New York, NY", None]),
             rng.choice(["d", "e", None]), rng.choice(["py", "sql,py", None]), rng.choice(["1", "2"])) for _ in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    for order in (cols, cols[::-1], ["job_id", "pay"]):
        if order == ["job_id", "pay"]:
            df = df.dropDuplicates(order + ["title", "company", "location"]).orderBy(*cols).dropDuplicates(["job_id", "pay", "company"])
            df = spark.createDataFrame(df.collect(), df.schema)
        whole = C.clean_postings(df, order_by=order)
        for read in (["title", "city_standardized"], ["title", "company", "city_standardized", "skills_normalized"], ["pay"], ["role_category", "skill_count", "state_standardized"]):
            got = C.clean_postings(df, order_by=order, columns=read)
            assert got.columns == read
            assert sorted(map(str, got.collect())) == sorted(map(str, whole.select(*read).collect())), (order, read)


def test_dedup_does_not_carry_what_is_not_read(spark):
    df = spark.createDataFrame([("1", "Data Analyst", "A", "NYC, NY", "text", "py")], "job_id string, title string, company string, location string, description string, skills string")
    plan = C.clean_postings(df, order_by=df.columns, columns=["title", "city_standardized"])._jdf.queryExecution().optimizedPlan().toString()
    kept = next(line for line in plan.splitlines() if "Aggregate" in line)
    assert "job_id" in kept and "description" not in kept and "skills" not in kept
