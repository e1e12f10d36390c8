"""the salary model is fitted on folded training rows and equals the one of all rows."""

import pytest

from pyspark.sql import functions as F

from postlens.operators import salary as S

ROWS = "job_id string, title string, location string, company string, skills string, company_size string, salary_min double, salary_max double"


def test_model_of_folded_rows_equals_the_model_of_all_rows(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = [(str(k % 50), ["Data Scientist", "Data Analyst", None][k % 3], ["Pune", "Bangalore, KA", None][k % 7 % 3], "c", "python,sql" if k % 4 else "aws",
             None if k % 5 == 0 else "Medium", float(5 + 10 * (k % 3) + k % 11) if k % 10 else None, float(9 + 10 * (k % 3) + k % 11)) for k in range(300)]
    df = spark.createDataFrame(rows, ROWS)
    model, train, m = S.train_model(df)
    assert train.count() < 300 and train.agg(F.sum("n")).first()[0] == m["samples"] == 300
    labelled = S.with_salary_inputs(S.training_rows(df))
    feats = S.build_features(labelled, labelled)
    plain = Pipeline(stages=[VectorAssembler(inputCols=S.FEATURES, outputCol="features"),
                             GBTRegressor(featuresCol="features", labelCol="target", maxIter=100, maxDepth=4, stepSize=0.1, seed=42)]).fit(feats)
    by = lambda mo: {tuple(r[:-1]): r["prediction"] for r in mo.transform(feats).select(*S.FEATURES, "prediction").distinct().collect()}
    want, got = by(plain), by(model)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    off = [abs(r.target - r.prediction) for r in model.transform(feats).select("target", "prediction").collect()]
    mean = labelled.agg(F.avg("target")).first()[0]
    assert m["mae_lpa"] == pytest.approx(sum(off) / 300, abs=0.006)
    assert m["mae_of_mean"] == pytest.approx(labelled.agg(F.avg(F.abs(F.col("target") - mean))).first()[0], abs=0.006)
