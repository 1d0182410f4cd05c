"""Dashboard, usage and outcome queries over the mapped tables, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators.quantiles import exact_quantiles
from lexmill.sources import views
from lexmill.sources.views import raw, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: All roles, so that counts can be zero-filled (fixed values).
ROLES = ("SUPER_ADMIN", "ADMIN", "USER")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _share(condition):
    return F.round(F.avg(F.when(condition, 1.0).otherwise(0.0)), 6)


@query(with_views("users requests", "SELECT id, coalesce(n, 0) AS queries FROM users LEFT JOIN (SELECT user_id, count(*) AS n FROM requests WHERE kind = 'query' GROUP BY 1) ON user_id = id"))
def user_dashboard(spark, sf):
    n = views.requests(spark, sf).filter("kind = 'query'").groupBy("user_id").agg(F.count("*").alias("n"))
    return views.users(spark, sf).join(n, F.col("id") == F.col("user_id"), "left").select("id", F.coalesce("n", F.lit(0)).alias("queries"))


@query(with_views("departments users assignments docs requests", """SELECT d.id, coalesce(m, 0) AS members, coalesce(dn, 0) AS documents, coalesce(qn, 0) AS queries FROM departments d
    LEFT JOIN (SELECT department_id, count(*) AS m FROM assignments JOIN users ON id = user_id AND role = 'USER' GROUP BY 1) a ON a.department_id = d.id
    LEFT JOIN (SELECT department_id, count(*) AS dn FROM docs GROUP BY 1) b ON b.department_id = d.id
    LEFT JOIN (SELECT department_id, count(*) AS qn FROM requests JOIN assignments USING (user_id) WHERE kind = 'query' GROUP BY 1) c ON c.department_id = d.id"""))
def department_dashboard(spark, sf):
    a = views.assignments(spark, sf)
    members = a.join(views.users(spark, sf).filter("role = 'USER'"), F.col("id") == F.col("user_id")).groupBy("department_id").agg(F.count("*").alias("members"))
    documents = views.docs(spark, sf).groupBy("department_id").agg(F.count("*").alias("documents"))
    per_user = views.requests(spark, sf).filter("kind = 'query'").groupBy("user_id").agg(F.count("*").alias("n"))
    queries = per_user.join(a, "user_id").groupBy("department_id").agg(F.sum("n").alias("queries"))
    out = views.departments(spark, sf).select("id")
    for part in (members, documents, queries):
        out = out.join(part.withColumnRenamed("department_id", "id"), "id", "left")
    return out.select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("members", "documents", "queries")])


@query(with_views("users", "SELECT role, count(id) AS n FROM (SELECT unnest(['SUPER_ADMIN', 'ADMIN', 'USER']) AS role) LEFT JOIN users USING (role) GROUP BY role"))
def users_by_role(spark, sf):
    counts = views.users(spark, sf).groupBy("role").agg(F.count("*").alias("n"))
    return spark.createDataFrame([(r,) for r in ROLES], "role string").join(counts, "role", "left").select("role", F.coalesce("n", F.lit(0)).alias("n"))


@query(with_views("docs requests users", "SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM requests WHERE kind = 'query') AS queries, (SELECT count(*) FROM users) AS users"))
def platform_totals(spark, sf):
    one = [views.docs(spark, sf).agg(F.count("*").alias("documents")), views.requests(spark, sf).filter("kind = 'query'").agg(F.count("*").alias("queries")), views.users(spark, sf).agg(F.count("*").alias("users"))]
    return one[0].join(F.broadcast(one[1])).join(F.broadcast(one[2]))  # one row each


@query("SELECT l_orderkey AS document_id, count(DISTINCT l_linenumber) AS parents, count(*) AS children, coalesce(nullif(count(*) FILTER (l_linestatus = 'O'), 0), count(*)) AS indexed FROM lineitem GROUP BY 1")
def index_manifest(spark, sf):
    counts = raw(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("document_id")).agg(F.count_distinct("l_linenumber").alias("parents"), F.count("*").alias("children"), F.count(F.when(F.col("l_linestatus") == "O", 1)).alias("i"))
    return counts.select("document_id", "parents", "children", F.coalesce(F.nullif("i", F.lit(0)), "children").alias("indexed"))


@query(with_views("requests", "SELECT kind, count(*) AS n, round(avg(latency), 6) AS mean, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95, round(avg(CASE WHEN latency > 50 THEN 1.0 ELSE 0.0 END), 6) AS slow FROM requests GROUP BY kind"))
def request_rollup(spark, sf):
    r = views.requests(spark, sf)
    counts = r.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("latency"), 6).alias("mean"), _share(F.col("latency") > 50).alias("slow"))
    middle = exact_quantiles(r, "kind", "latency", {"p50": 0.5, "p95": 0.95})
    return counts.join(middle, "kind", "left").select("kind", "n", "mean", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "slow")


@query(with_views("users requests", "SELECT role, count(DISTINCT user_id) AS active FROM requests JOIN users ON id = user_id WHERE status = 'ACTIVE' GROUP BY role"))
def active_users(spark, sf):
    return views.requests(spark, sf).select("user_id").distinct().join(views.users(spark, sf).filter("status = 'ACTIVE'"), F.col("id") == F.col("user_id")).groupBy("role").agg(F.count("*").alias("active"))


@query(with_views("docs users", "SELECT role, count(*) AS documents FROM docs JOIN users u ON u.id = owner_user_id GROUP BY role"))
def uploads_by_role(spark, sf):
    per = views.docs(spark, sf).groupBy("owner_user_id").agg(F.count("*").alias("n"))
    return per.join(views.users(spark, sf), F.col("id") == F.col("owner_user_id")).groupBy("role").agg(F.sum("n").alias("documents"))


@query(with_views("docs", "SELECT count(*) AS total, count(*) FILTER (status = 'READY') AS indexed, count(*) FILTER (status LIKE 'FAILED%') AS failed, round(count(*) FILTER (status = 'READY') / count(*), 6) AS success_rate FROM docs"))
def ingestion_outcomes(spark, sf):
    ready, failed = F.count(F.when(F.col("status") == "READY", 1)), F.count(F.when(F.col("status").startswith("FAILED"), 1))
    return views.docs(spark, sf).agg(F.count("*").alias("total"), ready.alias("indexed"), failed.alias("failed"), F.round(ready / F.count("*"), 6).alias("success_rate"))


@query(with_views("docs", "SELECT mime_type, count(*) AS n, round(avg(CASE WHEN status NOT LIKE 'FAILED%' THEN 1.0 ELSE 0.0 END), 6) AS success_rate FROM docs GROUP BY 1"))
def extraction_success(spark, sf):
    return views.docs(spark, sf).groupBy("mime_type").agg(F.count("*").alias("n"), _share(~F.col("status").startswith("FAILED")).alias("success_rate"))


@query(with_views("requests users assignments", """SELECT CASE grouping(day) WHEN 0 THEN 'day' ELSE CASE grouping(user_id) WHEN 0 THEN 'user' ELSE 'role' END END AS level,
    coalesce(day::VARCHAR, user_id::VARCHAR, role) AS value, count(*) AS n FROM (SELECT CAST(ts AS DATE) AS day, user_id, role FROM requests JOIN users ON id = user_id WHERE kind = 'query') GROUP BY GROUPING SETS ((day), (user_id), (role))
    UNION ALL SELECT 'department', department_id::VARCHAR, count(*) FROM requests JOIN assignments USING (user_id) WHERE kind = 'query' GROUP BY department_id"""))
def query_activity(spark, sf):
    q = views.requests(spark, sf).filter("kind = 'query'").join(views.users(spark, sf), F.col("id") == F.col("user_id"))
    q = q.select(F.to_date("ts").alias("day"), "user_id", "role")
    sets = q.groupingSets([["day"], ["user_id"], ["role"]], "day", "user_id", "role").agg(F.count("*").alias("n"), F.grouping("day").alias("gd"), F.grouping("user_id").alias("gu"))
    level = F.when(F.col("gd") == 0, "day").when(F.col("gu") == 0, "user").otherwise("role")
    out = sets.select(level.alias("level"), F.coalesce(F.col("day").cast("string"), F.col("user_id").cast("string"), "role").alias("value"), "n")
    per_user = views.requests(spark, sf).filter("kind = 'query'").groupBy("user_id").agg(F.count("*").alias("n"))
    departments = per_user.join(views.assignments(spark, sf), "user_id").groupBy("department_id").agg(F.sum("n").alias("n"))
    return out.unionByName(departments.select(F.lit("department").alias("level"), F.col("department_id").cast("string").alias("value"), "n"))


@query(with_views("requests", "SELECT kind, round(quantile_cont(latency, 0.95), 6) AS p95, round(max(latency), 6) AS longest FROM requests WHERE kind IN ('query', 'upload') GROUP BY kind"))
def latency_p95(spark, sf):
    r = views.requests(spark, sf).filter(F.col("kind").isin("query", "upload"))
    longest = r.groupBy("kind").agg(F.round(F.max("latency"), 6).alias("longest"))
    return longest.join(exact_quantiles(r, "kind", "latency", {"p95": 0.95}), "kind", "left").select("kind", F.round("p95", 6).alias("p95"), "longest")


@query(with_views("requests users", "SELECT role, count(*) AS attempts, count(*) FILTER (role = 'USER') AS blocked FROM requests JOIN users ON id = user_id WHERE kind = 'upload' GROUP BY role"))
def blocked_uploads(spark, sf):
    r = views.requests(spark, sf).filter("kind = 'upload'").groupBy("user_id").agg(F.count("*").alias("n")).join(views.users(spark, sf), F.col("id") == F.col("user_id"))
    return r.groupBy("role").agg(F.sum("n").alias("attempts"), F.sum(F.when(F.col("role") == "USER", F.col("n")).otherwise(0)).alias("blocked"))


@query(with_views("docs elements", "SELECT department_id, owner_user_id, sum(size_bytes)::BIGINT AS bytes, count(*) AS documents, coalesce(sum(v), 0)::BIGINT AS vectors FROM docs LEFT JOIN (SELECT document_id AS id, count(*) AS v FROM elements GROUP BY 1) USING (id) GROUP BY ROLLUP (department_id, owner_user_id)"))
def storage_rollup(spark, sf):
    vectors = views.elements(spark, sf).groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("v"))
    d = views.docs(spark, sf).select("id", "department_id", "owner_user_id", "size_bytes").join(vectors, "id", "left")
    return d.rollup("department_id", "owner_user_id").agg(F.sum("size_bytes").alias("bytes"), F.count("*").alias("documents"), F.coalesce(F.sum("v"), F.lit(0)).alias("vectors"))


@query(with_views("jobs", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, status, count(*) AS n FROM jobs GROUP BY 1, 2"))
def event_windows(spark, sf):
    out = views.jobs(spark, sf).groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("window_start"), "status").agg(F.count("*").alias("n"))
    return out
