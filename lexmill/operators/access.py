"""Access scope, requested documents, permissions and key lookups over whole tables of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Actions of each role (fixed values).
PERMISSIONS = {"upload": ("SUPER_ADMIN", "ADMIN"), "manage_users": ("SUPER_ADMIN", "ADMIN"), "read_audit": ("SUPER_ADMIN", "ADMIN"), "query": ("SUPER_ADMIN", "ADMIN", "USER")}


def record_outcome(requests: DataFrame, records: DataFrame, users: DataFrame) -> DataFrame:
    """(request_id, outcome) of (request_id, user_id, query_id): a query record is for its owner and for admins of either kind."""
    owned = records.select("query_id", F.col("user_id").alias("owner_id"))
    roles = users.select(F.col("id").alias("user_id"), "role")
    r = requests.join(owned, "query_id", "left").join(roles, "user_id", "left")
    allowed = (F.col("owner_id") == F.col("user_id")) | F.coalesce(F.col("role").isin("SUPER_ADMIN", "ADMIN"), F.lit(False))
    return r.select("request_id", F.when(F.col("owner_id").isNull(), "DOCUMENT_NOT_FOUND").when(allowed, "OK").otherwise("NOT_AUTHORIZED").alias("outcome"))


def accessible(users: DataFrame, assignments: DataFrame, docs: DataFrame, ready_only: bool = True) -> DataFrame:
    """Per user and department, what the user may see: (user_id, department_id) with the number of documents there.

    The scope is kept as departments, not as documents, so a Super Admin costs a row per department.
    """
    docs = docs.filter("status = 'READY'") if ready_only else docs
    counts = docs.groupBy("department_id").agg(F.count("*").alias("documents"))
    own = users.filter("role <> 'SUPER_ADMIN'").join(assignments, F.col("id") == F.col("user_id")).select("user_id", "department_id").join(counts, "department_id")
    every = counts.agg(F.collect_list(F.struct("department_id", "documents")).alias("d"))  # one row of departments
    supers = users.filter("role = 'SUPER_ADMIN'").join(F.broadcast(every)).select(F.col("id").alias("user_id"), F.explode("d").alias("d")).select("user_id", "d.*")
    return own.select("user_id", "department_id", "documents").unionByName(supers)


def filtered_documents(requests: DataFrame, users: DataFrame, assignments: DataFrame, docs: DataFrame, departments: DataFrame, page_size: int) -> DataFrame:
    """(request_id, id, position) of (request_id, user_id, status, department_id, page): newest first, a page at a time.

    A Super Admin's department filter selects; anybody else sees own departments, narrowed by the filter if it is one of
    these and else as if there were none.  A null status or department does not filter.  Only the newest documents of
    each department and status, as many as the furthest page needs, meet the requests.
    """
    asked = requests.join(users.select(F.col("id").alias("user_id"), "role"), "user_id")
    mine = assignments.groupBy("user_id").agg(F.collect_set("department_id").alias("mine"))
    every = departments.agg(F.collect_set("id").alias("every"))  # one row
    asked = asked.join(mine, "user_id", "left").join(F.broadcast(every))
    own = F.coalesce("mine", F.array().cast("array<int>"))
    filtered = F.array(F.col("department_id").cast("int"))
    sees = F.when(F.col("role") == "SUPER_ADMIN", F.when(F.col("department_id").isNull(), F.col("every")).otherwise(filtered))
    sees = sees.when(F.array_contains(own, F.col("department_id").cast("int")), filtered).otherwise(own)
    wanted = asked.select("request_id", "page", F.col("status").alias("wanted"), F.explode(sees.cast("array<int>")).alias("department_id"))
    most = requests.agg((F.max("page") * page_size).alias("most"))  # one row
    by = lambda keys: Window.partitionBy(*keys).orderBy(F.desc("created_at"), "id")
    newest = docs.select("department_id", "status", "id", "created_at").withColumn("n", F.row_number().over(by(["department_id", "status"])))
    newest = newest.join(F.broadcast(most)).filter(F.col("n") <= F.col("most"))
    found = wanted.join(newest.select("department_id", "status", "id", "created_at"), "department_id").filter(F.col("wanted").isNull() | (F.col("status") == F.col("wanted")))
    found = found.withColumn("position", F.row_number().over(by(["request_id"])))
    first = (F.greatest("page", F.lit(1)) - 1) * page_size
    return found.filter((F.col("position") > first) & (F.col("position") <= first + page_size)).select("request_id", "id", "position")


def requested_documents(requests: DataFrame, users: DataFrame, assignments: DataFrame, docs: DataFrame) -> DataFrame:
    """Outcome of (query_id, user_id, document_ids): all requested documents in scope, or DOCUMENT_ACCESS_DENIED.

    Null or empty lists ask for everything in scope.
    """
    asked = requests.select("query_id", "user_id", F.explode_outer(F.array_distinct("document_ids")).alias("document_id"))
    found = asked.join(docs.select(F.col("id").alias("document_id"), "department_id"), "document_id", "left")
    found = found.join(users.select(F.col("id").alias("user_id"), "role"), "user_id", "left")
    mine = assignments.select("user_id", "department_id", F.lit(True).alias("mine")).distinct()
    found = found.join(mine, ["user_id", "department_id"], "left")
    ok = F.col("document_id").isNotNull() & F.col("department_id").isNotNull() & ((F.col("role") == "SUPER_ADMIN") | F.coalesce("mine", F.lit(False)))
    out = found.groupBy("query_id").agg(F.count("document_id").alias("requested"), F.count(F.when(ok, 1)).alias("accessible"))
    return out.withColumn("outcome", F.when(F.col("requested") == 0, "ALL_IN_SCOPE").when(F.col("requested") == F.col("accessible"), "OK").otherwise("DOCUMENT_ACCESS_DENIED"))


def permission_column(role: Column, action: str) -> Column:
    return role.isin(*PERMISSIONS[action])


def may_act_on(actors: DataFrame, targets: DataFrame, assignments: DataFrame) -> DataFrame:
    """For each actor, how many targets share a department.

    Users fall into classes of equal departments.  Targets are counted by class, and classes, not users, are matched, so a
    department with a third of all users costs a row a class.
    """
    held = assignments.groupBy("user_id").agg(F.array_sort(F.collect_set("department_id")).alias("of"))
    of = lambda users, name: users.join(held, F.col("id") == F.col("user_id")).select(F.col("id").alias(name), "of")
    acting, counts = of(actors, "actor_id"), of(targets, "target_id").groupBy("of").agg(F.count("*").alias("n"))
    each = lambda d, name: d.select(F.col("of").alias(name), F.explode("of").alias("department_id"))
    met = each(acting.select("of").distinct(), "a").join(each(counts, "t"), "department_id").select("a", "t").distinct()
    sums = met.join(counts, F.col("t") == F.col("of")).groupBy("a").agg(F.sum("n").alias("targets"))
    return acting.join(sums, F.col("a") == F.col("of")).select("actor_id", "targets")


def lookup(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left lookup by key with a ``found`` flag."""
    return keys.join(table.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))
