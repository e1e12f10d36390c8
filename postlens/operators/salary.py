"""Salary: canonical role, features, heuristic and GBT model.

Multipliers come from small literal maps (no join); encoders map a category to
its position in the sorted class list computed from the training rows, with
-1 for unseen values. Class lists are distinct keys ranked once and joined
back, so their size never passes through the driver.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens import vocab as V
from postlens.functions.text import (
    contains_any,
    first_contains_label,
    literal_array,
    literal_map,
    split_list,
)
from postlens.functions.numeric import py_round
from postlens.functions.ordinals import ordinals
from postlens.session import stored

FEATURES = ["title_encoded", "location_encoded", "company_size_encoded",
            "skill_count", "premium_skill_count", "experience_level"]


def salary_role_col(title: Column, low: Column | None = None, longest_first: bool = False) -> Column:
    """First table role contained in the title, then broad fallbacks (all parts).

    In table order a short role hides longer ones below it; ``longest_first`` tries long names first.
    """
    low = F.lower(F.trim(F.coalesce(title, F.lit("")))) if low is None else low
    names = [role for role, _, _ in V.SALARY_BASE]
    rules = [((role,), role) for role in (sorted(names, key=len, reverse=True) if longest_first else names)] + list((tuple(k), r) for k, r in V.SALARY_ROLE_FALLBACKS)
    return first_contains_label(low, rules, F.lit(V.SALARY_ROLE_DEFAULT), all_of=True)


def city_key_col(location: Column) -> Column:
    """Lower-cased text before the first comma, stripped."""
    return F.trim(F.substring_index(F.lower(F.coalesce(location, F.lit(""))), ",", 1))


def plain_skills_col(skills: Column) -> Column:
    """Comma split, strip, lower, drop blanks."""
    return split_list(skills)


def experience_level_col(title: Column, low: Column | None = None) -> Column:
    """4 (head/director/...) > 3 (senior/lead/...) > 1 (junior/intern/...) > 2."""
    low = F.lower(F.coalesce(title, F.lit(""))) if low is None else low
    out = F.lit(V.EXPERIENCE_LEVEL_DEFAULT)
    for level, keys in reversed(V.EXPERIENCE_LEVEL_KEYWORDS):
        out = F.when(contains_any(low, keys), F.lit(level)).otherwise(out)
    return out


UNITS = {"lpa": 1.0, "inr_per_year": 1e-5, "inr_per_month": 12e-5, "thousand_inr_per_month": 0.12}


def to_lpa(amount: Column, unit: str = "lpa") -> Column:
    """An amount in lakhs per annum; sources that hold raw currency are converted where they are read."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}: {sorted(UNITS)}")
    return amount if unit == "lpa" else amount * UNITS[unit]


def salary_target_col(avg: Column | None, lo: Column, hi: Column) -> Column:
    """Avg, else mid of min and max, else min, else max; zero and null are missing."""
    def ok(c):
        return c.isNotNull() & (c != 0)

    out = F.when(ok(lo) & ok(hi), (lo + hi) / 2).when(ok(lo), lo).when(ok(hi), hi)
    if avg is not None:
        out = F.when(ok(avg), avg).otherwise(out)
    return out.cast("double")


def premium_count_col(skills: Column, premium: Sequence[str] = V.PREMIUM_SKILLS) -> Column:
    arr = literal_array(list(premium))
    return F.size(F.filter(skills, lambda s: F.array_contains(arr, s)))


def with_salary_inputs(df: DataFrame, title="title", location="location", size="company_size",
                       skills="skills") -> DataFrame:
    """Canonical role, city key, size (absent column -> Medium), parsed skills, level."""
    loc = F.col(location) if location in df.columns else (F.col("city") if "city" in df.columns else F.lit(None))
    size_col = F.col(size) if size in df.columns else F.lit("Medium")
    sk = F.col(skills) if skills in df.columns else F.lit(None).cast("string")
    staged = df.withColumn("_tl", F.lower(F.coalesce(F.col(title), F.lit(""))))
    return (staged.withColumn("role", salary_role_col(F.col(title), low=F.trim(F.col("_tl"))))
            .withColumn("city_key", city_key_col(loc))
            .withColumn("size_key", size_col)
            .withColumn("skill_list", plain_skills_col(sk))
            .withColumn("experience_level", experience_level_col(F.col(title), low=F.col("_tl")))
            .drop("_tl"))


def heuristic_salary(df: DataFrame, **cols) -> DataFrame:
    """F1: base range x location x size x (1 + 0.03 per premium skill) x experience.

    The premium factor applies to avg and max, not min. Unknown city or size
    multiplies by 1.0. Rounded to 2 decimals. Products keep the reference's
    left-to-right order so doubles agree bit for bit.
    """
    x = with_salary_inputs(df, **cols)
    base_min = literal_map([(r, float(lo)) for r, lo, _ in V.SALARY_BASE])
    base_max = literal_map([(r, float(hi)) for r, _, hi in V.SALARY_BASE])
    lo = F.coalesce(F.element_at(base_min, F.col("role")), F.lit(6.0))
    hi = F.coalesce(F.element_at(base_max, F.col("role")), F.lit(15.0))
    loc = F.coalesce(F.element_at(literal_map(V.LOCATION_MULTIPLIERS), F.col("city_key")), F.lit(1.0))
    size = F.coalesce(F.element_at(literal_map(V.COMPANY_SIZE_MULTIPLIERS), F.col("size_key")), F.lit(1.0))
    bonus = F.lit(1.0) + premium_count_col(F.col("skill_list")) * V.SKILL_PREMIUM_PER_SKILL
    exp = F.coalesce(F.element_at(literal_map(V.EXPERIENCE_MULTIPLIERS), F.col("experience_level")), F.lit(1.0))
    avg = (lo + hi) / 2 * loc * size * bonus * exp
    return x.select(
        "*",
        py_round(lo * loc * size * exp, 2).alias("salary_min_pred"),
        py_round(hi * loc * size * bonus * exp, 2).alias("salary_max_pred"),
        py_round(avg, 2).alias("salary_avg_pred"),
        F.lit("medium").alias("confidence"),
        F.lit("heuristic").alias("method"),
    )


def encode(df: DataFrame, train: DataFrame, key: str, out: str) -> DataFrame:
    """Position of ``key`` in the sorted distinct training values; unseen -> -1.

    The classes are a stored table: broadcast if its bytes allow, else joined by key, where AQE can split
    a frequent key's rows (each has one class).
    """
    classes = stored(ordinals(train, key, "_pos"), "classes").withColumnRenamed(key, "_k")
    joined = df.join(classes, df[key] == classes["_k"], "left")
    return joined.withColumn(out, F.coalesce(F.col("_pos"), F.lit(-1))).drop("_k", "_pos")


def training_rows(df: DataFrame, avg: str | None = None, lo: str = "salary_min", hi: str = "salary_max") -> DataFrame:
    """B16 + B18: rows with a positive salary target."""
    a = F.col(avg) if avg and avg in df.columns else None
    return df.withColumn("target", salary_target_col(a, F.col(lo), F.col(hi))).where(F.col("target") > 0)


def _model_inputs(df: DataFrame) -> DataFrame:
    """What the features are made of: role, city key, size, level and the counts of skills (folded rows hold them already)."""
    x = with_salary_inputs(df) if "role" not in df.columns else df
    if "skill_list" not in x.columns:
        return x
    return (x.withColumn("skill_count", F.size("skill_list"))
            .withColumn("premium_skill_count", premium_count_col(F.col("skill_list"))))


def folded(train: DataFrame, label: str = "target") -> DataFrame:
    """(inputs of the features, label, n): equal training rows as one row with their number, kept in the shared folder.

    Encoders, model and metrics read this table alone, so the postings are scanned once for them.
    """
    keys = ["role", "city_key", "size_key", "skill_count", "premium_skill_count", "experience_level", label]
    return stored(_model_inputs(train).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "training")


def build_features(df: DataFrame, train: DataFrame) -> DataFrame:
    """the six model features, encoders fitted on ``train``."""
    x = _model_inputs(df)
    t = with_salary_inputs(train) if "role" not in train.columns else train
    x = encode(x, t, "role", "title_encoded")
    x = encode(x, t, "city_key", "location_encoded")
    return encode(x, t, "size_key", "company_size_encoded")


def synthetic_labels(df: DataFrame, seed: int = 42, key_cols: Sequence[str] = ("job_id", "title", "company", "location")) -> DataFrame:
    """heuristic average x uniform noise in [0.9, 1.1], rounded to 2.

    The noise is a hash of the seed and the row's key, so it depends neither on partitioning nor on reruns.
    """
    h = heuristic_salary(df)
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols if c in df.columns]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *keys))
    uniform = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    noisy = py_round((F.col("salary_avg_pred") * (F.lit(0.9) + uniform * 0.2)), 2)
    return h.withColumn("target", noisy).drop("salary_min_pred", "salary_max_pred", "salary_avg_pred",
                                              "confidence", "method")


def train_model(df: DataFrame, min_labelled: int = 5, min_rows: int = 3, seed: int = 42,
                model_path: str | None = None):
    """GBT regressor (100 trees, depth 4, rate 0.1, seed 42) on the F2 features.

    Fewer than ``min_labelled`` labelled rows -> add synthetic labels (F3);
    fewer than ``min_rows`` in total -> heuristic mode (returns None).
    Returns ``(model, train_frame, metrics)``; metrics are training MAE and R2. The frame holds the training rows folded
    (:func:`folded`). A regression tree on squared errors depends on a feature vector's rows by their number and mean
    alone, so it is fitted on one weighted row per vector.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from postlens.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)  # GBT checkpoints its tree lineage into the shared folder
    labelled = with_salary_inputs(training_rows(df))
    rows = lambda t: t.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # noqa: E731 - one scalar, it decides the plan's shape
    train = folded(labelled)
    n = rows(train)
    if n < min_labelled:
        train = folded(labelled.unionByName(synthetic_labels(df), allowMissingColumns=True))
        n = rows(train)
    if n < min_rows:
        return None, None, {"mode": "heuristic", "samples": 0}
    feats = stored(build_features(train, train).groupBy(*FEATURES, "target").agg(F.sum("n").alias("n")), "features")
    vectors = feats.groupBy(*FEATURES).agg((F.sum(F.col("target") * F.col("n")) / F.sum("n")).alias("target"), F.sum("n").cast("double").alias("n"))
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=FEATURES, outputCol="features"),
        GBTRegressor(featuresCol="features", labelCol="target", weightCol="n", maxIter=100, maxDepth=4, stepSize=0.1, seed=seed),
    ])
    model = pipe.fit(stored(vectors, "vectors"))
    mean = feats.agg((F.sum(F.col("target") * F.col("n")) / F.sum("n")).alias("m"))
    off, from_mean = F.col("target") - F.col("prediction"), F.col("target") - F.col("m")
    e = model.transform(feats).crossJoin(F.broadcast(mean)).agg(
        (F.sum(F.abs(off) * F.col("n")) / n).alias("mae"), (F.sum(F.abs(from_mean) * F.col("n")) / n).alias("plain"),
        F.sum(off * off * F.col("n")).alias("left"), F.sum(from_mean * from_mean * F.col("n")).alias("all")).first()
    r2 = 1 - e["left"] / e["all"] if e["all"] else float("nan") if not e["left"] else float("-inf")  # as Spark's evaluator has it
    metrics = {"mode": "ml", "samples": n, "mae_lpa": round(e["mae"], 2), "r2_score": round(r2, 4), "mae_of_mean": round(e["plain"], 2)}
    if model_path:
        save_model(model, model_path, metrics)
    return model, train, metrics


def ml_predict(model, df: DataFrame, train: DataFrame) -> DataFrame:
    """avg floored at 1; spread max(15 %, 2); confidence high when avg > 3."""
    pred = model.transform(build_features(df, train))
    return pred.select(*[c for c in df.columns], F.col("role"), F.col("city_key"), *prediction_columns(F.col("prediction")))


def prediction_columns(prediction: F.Column) -> list[F.Column]:
    """the output columns of a raw prediction."""
    avg = F.greatest(prediction, F.lit(1.0))
    spread = F.greatest(avg * 0.15, F.lit(2.0))
    return [
        py_round(avg - spread, 2).alias("salary_min_pred"),
        py_round(avg + spread, 2).alias("salary_max_pred"),
        py_round(avg, 2).alias("salary_avg_pred"),
        F.when(avg > 3, "high").otherwise("medium").alias("confidence"),
        F.lit("ml_model").alias("method"),
    ]


def predict(df: DataFrame, model=None, train: DataFrame | None = None) -> DataFrame:
    """the model when one is given, else the heuristic."""
    if model is not None and train is not None:
        return ml_predict(model, df, train)
    return heuristic_salary(df)


def save_model(model, path: str, metrics: dict) -> None:
    """persist the pipeline, and its metadata as one JSON line next to it."""
    from pyspark.sql import SparkSession

    model.write().overwrite().save(path)
    meta = dict(metrics, model_type="GBTRegressor", features=FEATURES)
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta),)], "value string").write.mode("overwrite").text(
        path.rstrip("/") + "_metadata")


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def salary_market(pred: DataFrame) -> DataFrame:
    """Per role (avg/min/max/count), per city (avg/count) and overall, in one pass.

    ``GROUPING SETS ((role), (city_key), ())``; the ``level`` column names the set.
    """
    g = pred.groupingSets([["role"], ["city_key"], []], "role", "city_key").agg(
        py_round(F.avg("salary_avg_pred"), 2).alias("avg"),
        py_round(F.min("salary_avg_pred"), 2).alias("min"),
        py_round(F.max("salary_avg_pred"), 2).alias("max"),
        F.count(F.lit(1)).alias("count"),
        F.grouping_id().alias("_gid"),
    )
    level = F.when(F.col("_gid") == 1, "role").when(F.col("_gid") == 2, "location").otherwise("overall")
    return g.select(level.alias("level"), "role", "city_key", "avg", "min", "max", "count")
