import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[*]").appName("postlens-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf_small():
    return "/root/testdata/sf0.001"


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


JOB = dict(job_id="job_001", title="Data Scientist", company="TechCorp India", location="Bangalore, Karnataka",
           city="Bangalore", state="Karnataka",
           description="Looking for a data scientist with Python, SQL, machine learning and TensorFlow experience.",
           skills="python,sql,machine learning,tensorflow", post_date="2026-01-15", source="test")

JOBS = [
    JOB,
    dict(job_id="job_002", title="Frontend Developer", company="WebStudio", location="Remote", city="Remote",
         state="Remote", description="React and TypeScript developer needed. Remote friendly.",
         skills="react,typescript,css", post_date="2026-01-14", source="test"),
    dict(job_id="job_003", title="DevOps Engineer", company="CloudOps Ltd", location="Mumbai, Maharashtra",
         city="Mumbai", state="Maharashtra", description="Docker, Kubernetes and AWS experience required.",
         skills="docker,kubernetes,aws", post_date="2026-01-13", source="test"),
]
