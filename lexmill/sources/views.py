"""The model's tables as views of the given tables: each as a DataFrame and as the same SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = {
    "departments": "SELECT n_nationkey AS id, n_name AS name FROM nation",
    "users": """SELECT c_custkey AS id, lower(c_name) || '@example.com' AS email, c_name AS name,
        CASE WHEN c_custkey = 0 THEN 'SUPER_ADMIN' WHEN c_custkey % 10 = 1 THEN 'ADMIN' ELSE 'USER' END AS role,
        CASE WHEN c_acctbal < 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status, c_custkey = 0 AS is_seed FROM customer""",
    "assignments": """SELECT c_custkey AS user_id, c_nationkey AS department_id FROM customer WHERE c_custkey % 97 <> 0
        UNION SELECT c_custkey, (c_nationkey + 1) % 25 FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 97 <> 0""",
    "docs": """SELECT o_orderkey AS id, o_custkey AS owner_user_id, c_nationkey AS department_id, o_orderdate AS created_at,
        CASE o_orderstatus WHEN 'F' THEN 'READY' WHEN 'O' THEN 'QUEUED' ELSE 'FAILED_INDEXING' END AS status,
        CAST(round(o_totalprice * 100) AS BIGINT) AS size_bytes,
        'doc-' || o_orderkey || CASE substr(o_orderpriority, 1, 1) WHEN '5' THEN '.docx' WHEN '2' THEN '.PDF' ELSE '.pdf' END AS filename,
        CASE WHEN substr(o_orderpriority, 1, 1) = '3' THEN '' WHEN substr(o_orderpriority, 1, 1) = '4' THEN NULL ELSE o_orderpriority END AS title,
        CASE substr(o_orderpriority, 1, 1) WHEN '5' THEN 'application/msword' ELSE 'application/pdf' END AS mime_type
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "elements": """SELECT l_orderkey AS document_id, l_linenumber AS page, CASE l_returnflag WHEN 'A' THEN 'text' WHEN 'N' THEN 'table' ELSE 'picture' END AS modality,
        CASE WHEN l_linestatus = 'O' THEN 'part ' || l_partkey END AS content, CASE WHEN l_returnflag = 'R' THEN 'figure ' || l_suppkey END AS description,
        l_partkey AS part_id, l_suppkey AS supplier_id FROM lineitem""",
    "jobs": """SELECT event_id, user_id AS job_id, ts, CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN 'EXTRACTING' WHEN 'click' THEN 'CHUNKING'
        WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END AS status FROM events""",
    "requests": """SELECT event_id, user_id, ts, value AS latency, event_type,
        CASE event_type WHEN 'view' THEN 'query' WHEN 'purchase' THEN 'upload' WHEN 'error' THEN 'failed' ELSE 'other' END AS kind FROM events""",
}


def with_views(names: str, body: str) -> str:
    """SQL with the named views, and more common table expressions if the body starts with a comma."""
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in names.split())
    return f"WITH {head}{body}" if body.lstrip().startswith(",") else f"WITH {head} {body}"


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def departments(spark: SparkSession, sf: str) -> DataFrame:
    return raw(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


def users(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    role = F.when(key == 0, "SUPER_ADMIN").when(key % 10 == 1, "ADMIN").otherwise("USER")
    status = F.when(F.col("c_acctbal") < 0, "INACTIVE").otherwise("ACTIVE")
    email = F.concat(F.lower("c_name"), F.lit("@example.com"))
    return raw(spark, sf, "customer").select(key.alias("id"), email.alias("email"), F.col("c_name").alias("name"), role.alias("role"), status.alias("status"), (key == 0).alias("is_seed"))


def assignments(spark: SparkSession, sf: str) -> DataFrame:
    c = raw(spark, sf, "customer").filter(F.col("c_custkey") % 97 != 0)
    second = F.when(F.col("c_custkey") % 5 == 0, (F.col("c_nationkey") + 1) % 25)
    return c.select(F.col("c_custkey").alias("user_id"), F.explode(F.array_compact(F.array("c_nationkey", second))).alias("department_id"))


def docs(spark: SparkSession, sf: str) -> DataFrame:
    o = raw(spark, sf, "orders").join(raw(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    level = F.substring("o_orderpriority", 1, 1)
    status = F.when(F.col("o_orderstatus") == "F", "READY").when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("FAILED_INDEXING")
    ending = F.when(level == "5", ".docx").when(level == "2", ".PDF").otherwise(".pdf")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_user_id"), F.col("c_nationkey").alias("department_id"), F.col("o_orderdate").alias("created_at"),
        status.alias("status"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("size_bytes"), F.concat(F.lit("doc-"), F.col("o_orderkey"), ending).alias("filename"),
        F.when(level == "3", "").when(level != "4", F.col("o_orderpriority")).alias("title"),
        F.when(level == "5", "application/msword").otherwise("application/pdf").alias("mime_type"),
    )


def elements(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return raw(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page"), F.when(flag == "A", "text").when(flag == "N", "table").otherwise("picture").alias("modality"),
        F.when(F.col("l_linestatus") == "O", F.concat(F.lit("part "), "l_partkey")).alias("content"), F.when(flag == "R", F.concat(F.lit("figure "), "l_suppkey")).alias("description"),
        F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supplier_id"),
    )


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "signup", "QUEUED").when(kind == "view", "EXTRACTING").when(kind == "click", "CHUNKING").when(kind == "purchase", "COMPLETED").otherwise("FAILED")
    return raw(spark, sf, "events").select("event_id", F.col("user_id").alias("job_id"), "ts", status.alias("status"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    named = F.when(kind == "view", "query").when(kind == "purchase", "upload").when(kind == "error", "failed").otherwise("other")
    return raw(spark, sf, "events").select("event_id", "user_id", "ts", F.col("value").alias("latency"), "event_type", named.alias("kind"))
