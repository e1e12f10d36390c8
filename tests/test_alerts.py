import random

import pytest

from postlens.operators import alerts as A

POSTS = [
    dict(title="Lead Backend Developer", company="Kestrel Systems", location="Pune, Maharashtra",
         description="Services in Java with docker. Offer of 32 LPA.", salary="34 LPA", job_id="p1", job_type=None),
    dict(title="Data Analyst", company="Willow Foods", location="Chennai", description="Monthly figures in SQL and Excel, fully remote.",
         salary=None, job_id="p2", job_type=None),
    dict(title="Gardener", company="Greenhouse", location="Mumbai", description="Roses and hedges.", salary=None, job_id="p3", job_type=None),
]
SCHEMA = "title string, company string, location string, description string, salary string, job_id string, job_type string"


def test_sample_alerts(spark):
    df = spark.createDataFrame(POSTS, SCHEMA)
    got = {(r["alert_name"], r["job_id"]): r["reasons"] for r in A.match_alerts(df, A.sample_alerts()).collect()}
    assert set(got) == {("Backend posts in Pune", "p1"), ("Leads from 30 lakh", "p1"), ("Analysts who may stay at home", "p2")}
    assert got[("Leads from 30 lakh", "p1")] == "Title contains: lead; Salary: 34.0 LPA"
    assert got[("Backend posts in Pune", "p1")].startswith("Title contains: backend, developer; Skills found: docker, java")
    checked = {r["alert_name"]: r["match_count"] for r in A.check_alerts(df, [*A.sample_alerts(), A.Alert("none", company="nobody")]).collect()}
    assert checked == {"Backend posts in Pune": 1, "Analysts who may stay at home": 1, "Leads from 30 lakh": 1, "none": 0}


def test_criteria_are_lower_cased(spark):
    df = spark.createDataFrame(POSTS, SCHEMA)
    mixed = A.Alert("mixed", title_keywords=("BackEnd",), skills=("Docker",), location="PUNE", company="Kestrel", job_type=None)
    rows = A.match_alerts(df, [mixed]).collect()
    assert [r["job_id"] for r in rows] == ["p1"] and rows[0]["reasons"].startswith("Title contains: backend; Skills found: docker")


def test_salary_floor_rejects_low_pay(spark):
    alerts = [A.Alert("rich", min_salary_lpa=25.0)]
    df = spark.createDataFrame([("a", "Dev", "pays 10 lpa"), ("b", "Dev", "no number")],
                               "job_id string, title string, description string")
    assert [r["job_id"] for r in A.match_alerts(df, alerts).collect()] == ["b"]


def _table(spark, alerts):
    rows = [(a.name, None if a.title_keywords is None else list(a.title_keywords), None if a.skills is None else list(a.skills), a.location, a.company,
             a.min_salary_lpa, a.job_type) for a in alerts]
    return spark.createDataFrame(rows, A.ALERT_SCHEMA)


def _key(r):
    return r["alert_name"], r["job_id"] or "", r["reasons"]


FORMS = [A.match_alert_table, A.join_alert_table]


@pytest.mark.parametrize("form", FORMS)
def test_alert_table_equals_alert_list(spark, form):
    df = spark.createDataFrame(POSTS, SCHEMA)
    alerts = [*A.sample_alerts(), A.Alert("here", location="Chennai"), A.Alert("both", skills=("Java",), company="kestrel", min_salary_lpa=40.0),
              A.Alert("rich", min_salary_lpa=30.0), A.Alert("all"), A.Alert("none", title_keywords=()), A.Alert("empty word", title_keywords=("zzz", "")),
              A.Alert("short", title_keywords=("d",), location="p"), A.Alert("twice", skills=("java", "java", "ava")), A.Alert("type", job_type="remote")]
    table = _table(spark, alerts)
    got, want = sorted(map(_key, form(df, table.union(table.limit(3))).collect())), sorted(map(_key, A.match_alerts(df, alerts).collect()))
    assert got == want and got
    assert form(df, table.limit(0)).count() == 0
    assert form(df.limit(0), table).count() == 0


@pytest.mark.parametrize("form", FORMS)
def test_alert_table_on_random_rows(spark, form):
    rng = random.Random(5)
    words = ["data", "date", "ata", "lead", "ops", "dev", "devops", "java", "javascript", "sql", "go", "c", "Pune", "pu", "new delhi", "né"]
    text = lambda n: None if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    some = lambda: None if rng.random() < 0.4 else tuple(rng.choice(words) for _ in range(rng.randrange(1, 4)))
    one = lambda: None if rng.random() < 0.6 else rng.choice(words)
    posts = [(str(i), text(4), text(3), text(3), (text(8) or "") + rng.choice(["", " 12 lpa", " 40 LPA"]), rng.choice([None, "", "20 lpa"]), rng.choice([None, "dev", "go"]))
             for i in range(150)] * 2
    alerts = [A.Alert(f"a{i}", some(), some(), one(), one(), rng.choice([None, None, 15.0, 30.0]), one()) for i in range(80)]
    df = spark.createDataFrame(posts, "job_id string, title string, company string, location string, description string, salary string, job_type string")
    got, want = sorted(map(_key, form(df, _table(spark, alerts)).collect())), sorted(map(_key, A.match_alerts(df, alerts).collect()))
    assert len(got) > 1000 and got == want


def test_alert_index_meets_few_pairs(spark):
    """No alert is tested on every posting: the join of signatures and anchors gives about as many rows as there are matches."""
    posts = [(str(i), f"title {i % 50}", f"firm{i % 200:04d} ltd", "pune", "java") for i in range(4000)]
    df = spark.createDataFrame(posts, "job_id string, title string, company string, location string, description string")
    alerts = [A.Alert(f"a{i}", title_keywords=(f"title {i % 50}",), company=f"firm{i % 200:04d}", skills=("java",), location="pune") for i in range(1000)]
    index = A.AlertIndex(df, _table(spark, alerts))
    best = index._anchors().select("alert_id", "field").distinct().groupBy("field").count().collect()
    assert {r["field"] for r in best} == {"company"}
    assert index.matches().count() == sum(1 for a in range(1000) for i in range(4000) if i % 200 == a % 200 and str(i % 50).startswith(str(a % 50)))
    plan = index.pairs_met()._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_check_alert_table(spark):
    df = spark.createDataFrame(POSTS, SCHEMA)
    alerts = [*A.sample_alerts(), A.Alert("none", company="nobody")]
    got = {(r["alert_name"], r["match_count"], r["match_rank"], r["job_id"], r["reasons"]) for r in A.check_alert_table(df, _table(spark, alerts)).collect()}
    want = {(r["alert_name"], r["match_count"], r["match_rank"], r["job_id"], r["reasons"]) for r in A.check_alerts(df, alerts).collect()}
    assert got == want


def test_alerts_of_equal_criteria_are_one_rule(spark, monkeypatch):
    """Names meet the result last, in lots; the check ranks first rows per rule and never lists all matches."""
    monkeypatch.setattr(A, "NAMES_A_LOT", 7)
    df = spark.createDataFrame(POSTS * 3, SCHEMA)
    alerts = [A.Alert(f"a{i}", title_keywords=("Data", "dev")) for i in range(40)] + [A.Alert(f"b{i}", location="pune") for i in range(5)]
    alerts += [A.Alert("a3", location="pune"), A.Alert("a3", skills=("java",)), A.Alert("b1", company="nobody")]
    table = _table(spark, alerts)
    index = A.AlertIndex(df, table)
    assert index.alerts.count() == 4
    assert index.pairs_met().select("alert_id").distinct().count() <= 4
    listed = sorted(map(_key, A.match_alert_table(df, table).collect()))
    assert listed == sorted(map(_key, A.match_alerts(df, alerts).collect())) and listed
    monkeypatch.setattr(A.AlertIndex, "matches", None)
    order = ("job_id", "title", "company", "location", "description")
    got = {}
    for r in A.check_alert_table(df, table, first=4, order_cols=order).collect():
        got.setdefault((r["alert_name"], r["match_count"]), []).append((r["match_rank"], r["job_id"], r["reasons"]))
    every, want = A.match_alerts(df, alerts).collect(), {}
    for name in {a.name for a in alerts}:
        own = [r for r in every if r["alert_name"] == name]
        own.sort(key=lambda r: [(r[c] is not None, r[c] or "") for c in (*order, "reasons")])
        want[name, len(own)] = [(k + 1, r["job_id"], r["reasons"]) for k, r in enumerate(own[:4])] or [(None, None, None)]
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}
