"""Derived fixture views over the driver's TPC-H-like tables.

The same SQL text runs in Spark (tables bound as DataFrames through
``spark.sql(text, **frames)``) and in DuckDB (tables bound by name), so the
oracle and the engine read identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

POSTINGS_SQL = """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS job_id,
  CASE WHEN l_partkey % 97 = 0 THEN CAST(NULL AS STRING) ELSE
  split_part('Senior Data Scientist|data analyst|Data Engineer II|Machine Learning Engineer|Software Developer|SDE-2|Backend Engineer|UI Developer|Full Stack Engineer|Site Reliability Engineer|Tech Lead|Product Owner|Program Manager|Systems Analyst|  chief happiness officer  |Junior HTML Developer|Director of Engineering|Cloud Architect|QA Security Lead|Sr. Backend Developer', '|', CAST(1 + l_partkey % 20 AS INT)) END AS title,
  CASE WHEN l_suppkey % 41 = 0 THEN CAST(NULL AS STRING) ELSE s_name END AS company,
  split_part('Enterprise|Large|Medium|Small|Startup|Unknown', '|', CAST(1 + s_nationkey % 6 AS INT)) AS company_size,
  CASE WHEN l_orderkey % 53 = 0 THEN CAST(NULL AS STRING) ELSE
  split_part('Bangalore, Karnataka|Bengaluru, KA|Mumbai, Maharashtra|Pune|NYC, NY|San Fran, California|Remote - Anywhere|Hyderabad, Telangana|kolkata, west bengal|Delhi NCR', '|', CAST(1 + l_orderkey % 10 AS INT)) END AS location,
  concat('We need ', split_part('python, sql and aws|react, typescript and css|docker, kubernetes, terraform and ci/cd|C++ and c# with .net|machine learning, tensorflow and k8s|excel only', '|', CAST(1 + l_partkey % 6 AS INT)),
    ' skills. ', CAST(CAST(l_quantity AS INT) AS STRING), '+ years. ',
    split_part('Full-time remote role.|Part time contract.|Hybrid, on-site office.|Work from home.', '|', CAST(1 + l_orderkey % 4 AS INT)),
    CASE WHEN l_linenumber % 3 = 0 THEN concat(' Pay INR ', CAST(5 + l_suppkey % 40 AS STRING), ' - ', CAST(10 + l_suppkey % 40 AS STRING), ' LPA.') ELSE '' END) AS description,
  CASE WHEN l_partkey % 31 = 0 THEN CAST(NULL AS STRING) ELSE
  split_part('python,sql,machine learning,aws|py, Pandas ,sklearn,sql|["docker","k8s","terraform"]|reactjs,ts,node|python,sql|java,springboot,newtool|deep learning,machine learning,pytorch|', '|', CAST(1 + l_partkey % 8 AS INT)) END AS skills,
  CASE WHEN l_linenumber % 3 = 0 THEN CAST(5 + l_suppkey % 40 AS DOUBLE) END AS salary_min,
  CASE WHEN l_linenumber % 3 = 0 AND l_suppkey % 5 <> 0 THEN CAST(10 + l_suppkey % 40 AS DOUBLE) END AS salary_max,
  split_part('Full-time|Part-time|Contract|Remote', '|', CAST(1 + l_orderkey % 4 AS INT)) AS job_type,
  l_shipdate AS posted_at,
  split_part('api_a|api_b|sample', '|', CAST(1 + l_linenumber % 3 AS INT)) AS source
FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey
"""

PROFILES_SQL = """
SELECT c_custkey AS profile_id,
  split_part('Data Scientist|Software Engineer|DevOps Engineer|Product Manager', '|', CAST(1 + c_custkey % 4 AS INT)) AS title,
  CAST(c_custkey % 12 AS INT) AS experience_years,
  split_part('python,sql,machine learning|react,typescript|docker,kubernetes,aws|excel', '|', CAST(1 + c_nationkey % 4 AS INT)) AS skills,
  split_part('Bangalore|Remote,Pune|Mumbai|', '|', CAST(1 + c_custkey % 4 AS INT)) AS preferred_locations,
  concat('Supplier#00000000', CAST(c_custkey % 10 AS STRING)) AS preferred_companies,
  split_part('remote|hybrid|office', '|', CAST(1 + c_custkey % 3 AS INT)) AS job_types
FROM {customer}
"""

RESUMES_SQL = """
SELECT c_custkey AS resume_id,
  concat(split_part('Senior Data Scientist|I work as a Software Engineer|Fresher|Objective: to be a cloud engineer|Hiking and devops', '|', CAST(1 + c_custkey % 5 AS INT)), ' with ',
    CAST(1 + c_nationkey % 15 AS STRING), split_part('+ years of experience|  yrs in delivery| years', '|', CAST(1 + c_custkey % 3 AS INT)),
    '. Skills: ', split_part('Python, SQL, k8s|React and Node|pyspark, C++|none', '|', CAST(1 + c_custkey % 4 AS INT)),
    '. Based in ', split_part('Bangalore|Mumbai and Delhi|Europe|New Delhi, open to Remote', '|', CAST(1 + c_nationkey % 4 AS INT)),
    '. Batch: ', CAST(2005 + c_custkey % 20 AS STRING)) AS text
FROM {customer}
"""

ALERTS_SQL = """
SELECT concat('alert ', CAST(o_orderkey AS STRING)) AS alert_name,
  split(CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN split_part('Data,SDE|Senior|developer,analyst|Lead,Owner', '|', CAST(1 + o_custkey % 4 AS INT))
    WHEN 1 THEN split_part('engineer|scientist,analyst', '|', CAST(1 + o_custkey % 2 AS INT)) WHEN 2 THEN 'II,Junior' END, ',') AS title_keywords,
  split(CASE WHEN o_orderkey % 4 = 1 THEN split_part('python,SQL|docker|c++,react', '|', CAST(1 + o_custkey % 3 AS INT)) END, ',') AS skills,
  CASE WHEN o_orderkey % 4 <> 2 THEN split_part('bangalore|Pune|mumbai|NYC|Delhi', '|', CAST(1 + o_custkey % 5 AS INT)) END AS location,
  concat('supplier#', lpad(CAST(1 + o_custkey % 100 AS STRING), 9, '0')) AS company,
  CASE WHEN o_orderkey % 4 IN (1, 3) THEN CAST(10 + o_custkey % 30 AS DOUBLE) END AS min_salary_lpa,
  CASE WHEN o_orderkey % 4 = 2 THEN split_part('Remote|contract|Part-time', '|', CAST(1 + o_custkey % 3 AS INT)) END AS job_type
FROM {orders}
"""

_VIEWS = {
    "postings": (POSTINGS_SQL, ("lineitem", "supplier")),
    "profiles": (PROFILES_SQL, ("customer",)),
    "resumes": (RESUMES_SQL, ("customer",)),
    "alerts": (ALERTS_SQL, ("orders",)),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a DataFrame (parquet; pruning and pushdown apply)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived fixture view (``postings``, ``profiles``, ``resumes``, ``alerts``)."""
    sql, deps = _VIEWS[name]
    frames = {d: table(spark, sf_dir, d) for d in deps}
    return spark.sql(sql, **frames)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "postings")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "profiles")


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "resumes")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alert per row of ``orders`` (15,000 at sf0.01)."""
    return view(spark, sf_dir, "alerts")


def duckdb_view(name: str) -> str:
    """The same view text for DuckDB, where base tables are registered by name."""
    sql, deps = _VIEWS[name]
    return sql.format(**{d: d for d in deps})


def duckdb_with(*names: str) -> str:
    """``WITH`` prefix defining the requested derived views for an oracle query."""
    return "WITH " + ",\n".join(f"{n} AS (\n{duckdb_view(n)}\n)" for n in names) + "\n"
