from pyspark.sql import functions as F

from postlens.operators import extract as X


def _parse(spark, text, as_of=2026):
    df = spark.createDataFrame([(1, text)], "resume_id int, text string")
    return X.parse_resumes(df, as_of_year=as_of).collect()[0]


def test_resume_skills(spark):
    lines = {"Tools of my trade: Python and SQL, with postgres behind them.": {"python", "sql", "postgresql"},
             "Moved our jobs to k8s; before that plain node servers.": {"kubernetes", "node.js"},
             "Built forecasts (machine learning) on pyspark and sklearn.": {"machine learning", "spark", "scikit-learn"},
             "Pottery, sailing and long walks.": set()}
    for text, want in lines.items():
        got = set(_parse(spark, text)["skills"])
        assert want <= got and (want or not got), (text, got)


def test_resume_experience(spark):
    cases = {"Bridges and roads: 12+ years of experience": 12, "Some 4 yrs experience with tills": 4, "Experience: 9 years": 9,
             "6 years in logistics": 6, "Fresher, available at once": 0, "Batch: 2021, B.Tech": 5, "Batch of 1998 only": 0}
    for text, want in cases.items():
        assert _parse(spark, text)["experience_years"] == want, text


def test_resume_title_and_locations(spark):
    assert _parse(spark, "Worked as senior data scientist in a bank")["title"] == "Senior Data Scientist"
    assert _parse(spark, "Now: DEVOPS ENGINEER, nights")["title"] == "Devops Engineer"
    assert _parse(spark, "Anything with people and boats")["title"] == ""
    assert _parse(spark, "Director of gardens")["title"] == "Cto"  # 'cto' inside 'director'
    assert _parse(spark, "Mumbai or remote, please")["preferred_locations"] == ["Mumbai", "Remote"]


def test_salary_lpa(spark):
    df = spark.createDataFrame([("from 14-18 LPA",), ("7.5 lakh",), ("by agreement",), (None,)], "t string")
    got = [r[0] for r in df.select(X.salary_lpa_col(F.col("t"))).collect()]
    assert got == [18.0, 7.5, None, None]


def test_experience_levels_keep_zero_classes(spark):
    df = spark.createDataFrame([("A junior place, 2 yrs at most",), ("Principal of a team",)], "description string")
    got = {r["level"]: r["count"] for r in X.experience_levels(df).collect()}
    assert got == {"Entry Level (0-2 yrs)": 1, "Mid Level (3-5 yrs)": 0, "Senior (6-10 yrs)": 0, "Expert (10+ yrs)": 1}


def test_substring_counts(spark):
    df = spark.createDataFrame([("Python and SQL for reports",), ("java",), (None,)], "description string")
    got = dict((r["skill"], r["count"]) for r in X.substring_skill_counts(df).collect())
    assert got["python"] == 1 and got["sql"] == 1 and got["java"] == 1 and got["r"] == 1


def test_title_boundary_flag(spark):
    df = spark.createDataFrame([("director of sales",), ("the cto of us",)], "t string")
    got = lambda **o: [r[0] for r in df.select(X.resume_title_col(F.col("t"), **o)).collect()]
    assert got() == ["Cto", "Cto"] and got(boundary=True)[1] == "Cto" and got(boundary=True)[0] != "Cto"


def test_unicode_space_like_python(spark):
    import re

    from postlens import vocab as V

    texts = ["Full\u00a0time role", "3\u00a0years", "pay \u20b9\u00a05,00,000", "mid\u2003level"]
    df = spark.createDataFrame([(str(i), t, t) for i, t in enumerate(texts)], "job_id string, description string, title string")
    assert X.salary_mentions(df).first()["total_mentions"] == sum(len(re.findall(V.SALARY_TEXT_PATTERN, t, re.I)) for t in texts) == 1
    levels = {r["level"]: r["count"] for r in X.experience_levels(df).collect()}
    assert levels["Mid Level (3-5 yrs)"] == 2
    assert {r["job_type"]: r["count"] for r in X.job_types_from_text(df).collect()}["Full-time"] == 1
