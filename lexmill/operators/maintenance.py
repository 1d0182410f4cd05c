"""Key-scoped table maintenance as DataFrame rewrites: replace, upsert, cascade delete, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replace_by_key(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``target`` whose key has no new rows, and the new rows."""
    return target.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert_latest(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """One row a key: the highest version, the new one among equals."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_new")


def cascade_delete(deleted: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """What stays of each (table, key column) once the ids of ``deleted`` (id) are gone; children go with their document."""
    return {name: t.join(deleted, t[key] == deleted["id"], "left_anti") for name, (t, key) in tables.items()}


def resolve_upload(uploads: DataFrame, users: DataFrame, assignments: DataFrame) -> DataFrame:
    """Department and outcome of (upload_id, user_id, requested_department, title, filename)."""
    own = assignments.groupBy("user_id").agg(F.sort_array(F.collect_set("department_id")).alias("mine"))
    u = uploads.join(users.select(F.col("id").alias("user_id"), "role"), "user_id").join(own, "user_id", "left")
    department = F.coalesce("requested_department", F.get("mine", F.lit(0)))
    outcome = (
        F.when(F.col("role") == "USER", "UPLOAD_FORBIDDEN").when(department.isNull(), "DEPARTMENT_REQUIRED")
        .when((F.col("role") == "ADMIN") & ~F.coalesce(F.array_contains("mine", department), F.lit(False)), "OUTSIDE_SCOPE").otherwise("QUEUED")
    )
    title = F.coalesce(F.nullif("title", F.lit("")), "filename")
    return u.select("upload_id", department.alias("department_id"), title.alias("title"), outcome.alias("outcome"), F.when(outcome == "QUEUED", 0).alias("progress"))


def upload_job(resolved: DataFrame) -> DataFrame:
    """(job_id, document_id, status, progress): the queued job that goes with each accepted upload."""
    return resolved.filter("outcome = 'QUEUED'").select(F.concat(F.lit("job-"), "upload_id").alias("job_id"), F.col("upload_id").alias("document_id"), F.lit("QUEUED").alias("status"), "progress")


def user_upsert(users: DataFrame, incoming: DataFrame) -> DataFrame:
    """Action per email of (email, name, role) requests against users: insert, update with reactivation, or conflict."""
    new = incoming.select(F.lower(F.trim("email")).alias("email"), F.col("name").alias("new_name"), F.col("role").alias("new_role"))
    both = users.select(F.lower("email").alias("email"), "name", "role", "status").join(new, "email", "full_outer")
    action = F.when(F.col("new_role").isNull(), "keep").when(F.col("role").isNull(), "insert").when(F.col("role") == F.col("new_role"), "update").otherwise("conflict")
    changed = action.isin("insert", "update")
    return both.select(
        "email", action.alias("action"), F.when(changed, F.col("new_name")).otherwise(F.col("name")).alias("name"),
        F.coalesce("role", "new_role").alias("role"), F.when(changed, "ACTIVE").otherwise(F.col("status")).alias("status"),
    )


def get_or_create(names: DataFrame, departments: DataFrame) -> DataFrame:
    """Distinct trimmed names with whether they were there."""
    want = names.select(F.trim("name").alias("name")).filter("name <> ''").distinct()
    return want.join(departments.select(F.trim("name").alias("name"), "id").distinct(), "name", "left").select("name", "id", F.col("id").isNull().alias("created"))


def merge_assignments(old: DataFrame, new: DataFrame, replace: Column | None = None) -> DataFrame:
    """Distinct (user_id, department_id) after adding ``new``; users with ``replace`` true lose their others first."""
    if replace is not None:
        old = old.join(new.filter(replace).select("user_id").distinct(), "user_id", "left_anti")
    return old.unionByName(new.select("user_id", "department_id")).distinct()


def remove_memberships(users: DataFrame, assignments: DataFrame, removals: DataFrame) -> DataFrame:
    """Status of every user after removing (user_id, department_id): computed on what remains, seeds untouched."""
    seeds = users.filter("is_seed").select(F.col("id").alias("user_id"))
    effective = removals.join(seeds, "user_id", "left_anti").distinct()
    rest = assignments.join(effective, ["user_id", "department_id"], "left_anti").groupBy("user_id").agg(F.count("*").alias("remaining"))
    hit = effective.join(assignments, ["user_id", "department_id"], "left_semi").select("user_id").distinct().withColumn("hit", F.lit(True))
    u = users.join(rest, F.col("id") == rest["user_id"], "left").drop("user_id").join(hit, F.col("id") == hit["user_id"], "left")
    remaining = F.coalesce("remaining", F.lit(0))
    off = F.col("hit").isNotNull() & ((F.col("role") == "ADMIN") | ((F.col("role") == "USER") & (remaining == 0)))
    return u.select("id", F.when(off, "INACTIVE").otherwise(F.col("status")).alias("status"), remaining.alias("remaining"))
