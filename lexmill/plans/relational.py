"""Queries of access, maintenance, joins, windows and limits over the mapped tables, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import scalars
from lexmill.operators import access, corpus, maintenance
from lexmill.sources import views
from lexmill.sources.views import raw, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# --- sources


@query(with_views("docs", """SELECT id, CASE WHEN NOT lower(filename) LIKE '%.pdf' THEN 'INVALID_FILE_TYPE' WHEN size_bytes > 52428800 THEN 'FILE_TOO_LARGE' ELSE 'ACCEPTED' END AS reason FROM docs"""))
def upload_validation(spark, sf):
    d = views.docs(spark, sf)
    reason = F.when(~F.lower("filename").endswith(".pdf"), "INVALID_FILE_TYPE").when(F.col("size_bytes") > 50 * 1024 * 1024, "FILE_TOO_LARGE").otherwise("ACCEPTED")
    return d.select("id", reason.alias("reason"))


@query("SELECT doc_id, CASE WHEN vec_id IS NULL THEN 'missing' ELSE 'ready' END AS status FROM documents LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) ON doc_id = vec_id")
def artifact_status(spark, sf):
    made = raw(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("made")).distinct()
    return raw(spark, sf, "documents").select("doc_id").join(made, "doc_id", "left").select("doc_id", F.when(F.col("made").isNull(), "missing").otherwise("ready").alias("status"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_artifacts(spark, sf):
    return raw(spark, sf, "documents").select("doc_id").join(raw(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


def _elements_sql() -> str:
    clean = r"regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g')"
    parts = " UNION ALL ".join(
        rf"SELECT page_id, headed, '{kind}' AS element_type, regexp_extract_all(h, '(?is)<img(?: [^>]*)?>') AS f FROM c" if tag == "img"
        else rf"SELECT page_id, headed, '{kind}', regexp_extract_all(h, '(?is)<{tag}(?: [^>]*)?>(.*?)</{tag}>', 1) AS f FROM c" for tag, kind in reversed(corpus.PAGE_TAGS.items())
    )
    return rf"""WITH b AS (SELECT page_id, {clean} AS h FROM pages), c AS (SELECT *, regexp_matches(h, '(?is)<h1(?: [^>]*)?>.*?</h1>') AS headed FROM b), p AS ({parts})
      SELECT page_id, page_id || '-' || element_type || '-' || (i - 1) AS element_id, CASE WHEN headed AND element_type NOT IN ('title', 'heading') THEN page_id || '-heading-0' ELSE page_id::VARCHAR END AS parent_id,
        element_type, (i - 1)::INT AS position, trim(CASE WHEN element_type = 'image' THEN regexp_extract(f[i], '(?is)\salt="([^"]*)"', 1) ELSE regexp_replace(f[i], '(?s)<[^>]*>', ' ', 'g') END) AS content
      FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM p)"""


@query(_elements_sql())
def extract_elements(spark, sf):
    return corpus.page_elements(raw(spark, sf, "pages"))


@query("SELECT event_id, CAST(json_extract_string(coalesce(props, '{}'), '$.k') AS INT) AS k FROM events")
def parse_sources(spark, sf):
    return raw(spark, sf, "events").select("event_id", F.from_json(F.coalesce("props", F.lit("{}")), "k INT")["k"].alias("k"))


#: Query records: views in the event table, with the sources kept as JSON or null.
RECORDS = "records AS (SELECT user_id, event_id AS query_id, ts AS created_at, event_type || '?' AS query_text, CASE WHEN value > 20 THEN 'Answer ' || event_id END AS answer, CASE WHEN props IS NOT NULL THEN '[' || props || ']' END AS sources_json FROM events WHERE event_type = 'view')"


def records(spark, sf):
    e = raw(spark, sf, "events").filter("event_type = 'view'")
    answer = F.when(F.col("value") > 20, F.concat(F.lit("Answer "), "event_id"))
    sources = F.when(F.col("props").isNotNull(), F.concat(F.lit("["), "props", F.lit("]")))
    return e.select("user_id", F.col("event_id").alias("query_id"), F.col("ts").alias("created_at"), F.concat("event_type", F.lit("?")).alias("query_text"), answer.alias("answer"), sources.alias("sources_json"))


@query(f"""WITH {RECORDS}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, query_id) AS position FROM records QUALIFY position <= 50)
    SELECT user_id, query_id, position, query_text, coalesce(answer, '') AS answer, coalesce(json_array_length(sources_json), 0)::INT AS retrieved_chunks, coalesce(array_to_string(json_extract_string(sources_json, '$[*].k'), ','), '') AS sources FROM l""")
def query_responses(spark, sf):
    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), "query_id")
    r = records(spark, sf).withColumn("position", F.row_number().over(order)).filter("position <= 50")
    parsed = F.coalesce(F.from_json("sources_json", "array<struct<k:int>>"), F.array().cast("array<struct<k:int>>"))
    return r.select("user_id", "query_id", "position", "query_text", F.coalesce("answer", F.lit("")).alias("answer"), F.size(parsed).alias("retrieved_chunks"), F.array_join(parsed["k"].cast("array<string>"), ",").alias("sources"))


@query(f"WITH {RECORDS} SELECT count(*) AS queries, round(avg(CASE WHEN answer IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS answered, round(avg(CASE WHEN coalesce(json_array_length(sources_json), 0) > 0 THEN 1.0 ELSE 0.0 END), 6) AS cited, round(avg(CASE WHEN answer IS NOT NULL AND coalesce(json_array_length(sources_json), 0) > 0 THEN 1.0 ELSE 0.0 END), 6) AS grounded FROM records")
def citation_coverage(spark, sf):
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    answered, cited = F.col("answer").isNotNull(), F.coalesce(F.json_array_length("sources_json"), F.lit(0)) > 0
    return records(spark, sf).agg(F.count("*").alias("queries"), share(answered).alias("answered"), share(cited).alias("cited"), share(answered & cited).alias("grounded"))


# --- table maintenance


@query(with_views("elements docs", """SELECT document_id, page, modality, count(*) AS n FROM elements WHERE document_id NOT IN (SELECT id FROM docs WHERE status = 'FAILED_INDEXING') GROUP BY ALL
    UNION ALL SELECT id, 1, 'text', 1 FROM docs WHERE status = 'FAILED_INDEXING'"""))
def replace_elements(spark, sf):
    fresh = views.docs(spark, sf).filter("status = 'FAILED_INDEXING'").select(F.col("id").alias("document_id"), F.lit(1).alias("page"), F.lit("text").alias("modality"))
    return maintenance.replace_by_key(views.elements(spark, sf).select("document_id", "page", "modality"), fresh, "document_id").groupBy("document_id", "page", "modality").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT user_id AS chunk_id, ts AS version, event_id, 0 AS new FROM events WHERE event_type <> 'purchase' UNION ALL SELECT user_id, ts, event_id, 1 FROM events WHERE event_type = 'purchase')
    SELECT chunk_id, version, event_id FROM b QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY version DESC, new DESC) = 1""")
def index_upsert(spark, sf):
    e = raw(spark, sf, "events")
    rows = e.select(F.col("user_id").alias("chunk_id"), F.col("ts").alias("version"), "event_id", "event_type")
    return maintenance.upsert_latest(rows.filter("event_type <> 'purchase'").drop("event_type"), rows.filter("event_type = 'purchase'").drop("event_type"), "chunk_id", "version")


@query(with_views("docs elements", """, gone AS (SELECT id FROM docs WHERE status = 'FAILED_INDEXING')
    SELECT 'documents' AS name, count(*) AS left_rows FROM docs WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'elements', count(*) FROM elements WHERE document_id NOT IN (SELECT id FROM gone)"""))
def cascade_delete(spark, sf):
    d, e = views.docs(spark, sf), views.elements(spark, sf)
    gone = d.filter("status = 'FAILED_INDEXING'").select(F.col("id").alias("id"))
    rest = maintenance.cascade_delete(gone, {"documents": (d, "id"), "elements": (e, "document_id")})
    counts = [t.agg(F.lit(name).alias("name"), F.count("*").alias("left_rows")) for name, t in rest.items()]
    return counts[0].unionByName(counts[1])


@query("""SELECT conv_id, '[' || string_agg('{"turn":' || turn || ',"n_chars":' || length(text) || '}', ',' ORDER BY turn) || ']' AS sources_json FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def query_log(spark, sf):
    c = raw(spark, sf, "conversations").filter("role = 'assistant'")
    return c.groupBy("conv_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("turn", F.length("text").alias("n_chars"))))).alias("sources_json"))


@query(with_views("docs", """SELECT 'DOCUMENT_UPLOADED' AS event_type, id AS resource_id, CASE WHEN title IS NULL OR title = '' THEN '{}' ELSE '{"title":"' || title || '"}' END AS details_json FROM docs"""))
def audit_append(spark, sf):
    details = F.to_json(F.map_filter(F.create_map(F.lit("title"), F.nullif("title", F.lit(""))), lambda k, v: v.isNotNull()))
    return views.docs(spark, sf).select(F.lit("DOCUMENT_UPLOADED").alias("event_type"), F.col("id").alias("resource_id"), details.alias("details_json"))


@query(with_views("docs users assignments", """, m AS (SELECT user_id, min(department_id) AS first, list(DISTINCT department_id) AS mine FROM assignments GROUP BY user_id),
    r AS (SELECT d.id AS upload_id, role, CASE WHEN d.id % 3 = 0 THEN NULL ELSE d.department_id END AS req, first, mine, title, filename FROM docs d JOIN users u ON u.id = owner_user_id LEFT JOIN m ON m.user_id = u.id),
    o AS (SELECT *, coalesce(req, first) AS department_id, CASE WHEN role = 'USER' THEN 'UPLOAD_FORBIDDEN' WHEN coalesce(req, first) IS NULL THEN 'DEPARTMENT_REQUIRED'
      WHEN role = 'ADMIN' AND NOT coalesce(list_contains(mine, coalesce(req, first)), false) THEN 'OUTSIDE_SCOPE' ELSE 'QUEUED' END AS outcome FROM r)
    SELECT upload_id, department_id, coalesce(nullif(title, ''), filename) AS title, outcome, CASE WHEN outcome = 'QUEUED' THEN 0 END AS progress FROM o"""))
def resolve_upload(spark, sf):
    d = views.docs(spark, sf)
    asked = F.when(F.col("id") % 3 != 0, F.col("department_id"))
    uploads = d.select(F.col("id").alias("upload_id"), F.col("owner_user_id").alias("user_id"), asked.alias("requested_department"), "title", "filename")
    return maintenance.resolve_upload(uploads, views.users(spark, sf), views.assignments(spark, sf))


@query(ORACLES["resolve_upload"].replace("SELECT upload_id, department_id, coalesce", "SELECT 'job-' || upload_id AS job_id, upload_id AS document_id, outcome AS status, 0 AS progress FROM o WHERE outcome = 'QUEUED'\x00").split("\x00")[0])
def upload_jobs(spark, sf):
    return maintenance.upload_job(resolve_upload(spark, sf))


@query(with_views("docs", "SELECT id, upper(substr(f, 1, 1)) || substr(f, 2) AS title FROM (SELECT id, replace(regexp_replace(filename, '(?i)\\.pdf$', ''), '_', ' ') AS f FROM docs)"))
def default_titles(spark, sf):
    return views.docs(spark, sf).select("id", scalars.default_title(F.col("filename")).alias("title"))


@query(with_views("users", """, n AS (SELECT DISTINCT lower('Customer#' || lpad(s_suppkey::VARCHAR, 9, '0') || '@EXAMPLE.com') AS email, s_name AS name, CASE WHEN s_nationkey % 2 = 0 THEN 'USER' ELSE 'ADMIN' END AS role FROM supplier)
    SELECT email, CASE WHEN n.role IS NULL THEN 'keep' WHEN u.role IS NULL THEN 'insert' WHEN u.role = n.role THEN 'update' ELSE 'conflict' END AS action,
    CASE WHEN n.role IS NOT NULL AND (u.role IS NULL OR u.role = n.role) THEN n.name ELSE u.name END AS name, coalesce(u.role, n.role) AS role,
    CASE WHEN n.role IS NOT NULL AND (u.role IS NULL OR u.role = n.role) THEN 'ACTIVE' ELSE u.status END AS status FROM users u FULL JOIN n USING (email)"""))
def user_upsert(spark, sf):
    s = raw(spark, sf, "supplier")
    email = F.concat(F.lit("Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.lit("@EXAMPLE.com"))
    return maintenance.user_upsert(views.users(spark, sf), s.select(email.alias("email"), F.col("s_name").alias("name"), F.when(F.col("s_nationkey") % 2 == 0, "USER").otherwise("ADMIN").alias("role")))


@query(with_views("departments", """, w AS (SELECT DISTINCT trim(' NATION_' || (c_nationkey + 5) || ' ') AS name FROM customer) SELECT w.name, id, id IS NULL AS created FROM w LEFT JOIN departments d ON d.name = w.name"""))
def dept_upsert(spark, sf):
    names = raw(spark, sf, "customer").select(F.concat(F.lit(" NATION_"), F.col("c_nationkey") + 5, F.lit(" ")).alias("name"))
    return maintenance.get_or_create(names, views.departments(spark, sf))


@query(with_views("assignments", """, n AS (SELECT c_custkey AS user_id, (c_nationkey + 2) % 25 AS department_id, c_acctbal < 0 AS rep FROM customer)
    SELECT user_id, department_id FROM assignments WHERE user_id NOT IN (SELECT user_id FROM n WHERE rep) UNION SELECT user_id, department_id FROM n"""))
def assignment_merge(spark, sf):
    new = raw(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), ((F.col("c_nationkey") + 2) % 25).alias("department_id"), (F.col("c_acctbal") < 0).alias("rep"))
    return maintenance.merge_assignments(views.assignments(spark, sf), new, F.col("rep"))


@query(with_views("users assignments", """, r AS (SELECT c_custkey AS user_id, c_nationkey AS department_id FROM customer WHERE c_custkey <> 0 AND c_mktsegment = 'BUILDING'),
    a2 AS (SELECT user_id, count(*) AS remaining FROM assignments WHERE (user_id, department_id) NOT IN (SELECT (user_id, department_id) FROM r) GROUP BY user_id),
    h AS (SELECT DISTINCT user_id FROM r JOIN assignments USING (user_id, department_id))
    SELECT id, CASE WHEN h.user_id IS NOT NULL AND (role = 'ADMIN' OR (role = 'USER' AND coalesce(remaining, 0) = 0)) THEN 'INACTIVE' ELSE status END AS status, coalesce(remaining, 0) AS remaining
    FROM users LEFT JOIN a2 ON a2.user_id = id LEFT JOIN h ON h.user_id = id"""))
def membership_removal(spark, sf):
    gone = raw(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("department_id"))
    return maintenance.remove_memberships(views.users(spark, sf), views.assignments(spark, sf), gone)


# --- access and filters


@query(with_views("users assignments docs", """, c AS (SELECT department_id, count(*) AS documents FROM docs WHERE status = 'READY' GROUP BY 1)
    SELECT user_id, department_id, documents FROM users JOIN assignments ON user_id = id JOIN c USING (department_id) WHERE role <> 'SUPER_ADMIN' UNION ALL SELECT id, department_id, documents FROM users, c WHERE role = 'SUPER_ADMIN'"""))
def access_scope(spark, sf):
    return access.accessible(views.users(spark, sf), views.assignments(spark, sf), views.docs(spark, sf))


@query(with_views("users assignments docs", """, a AS (SELECT DISTINCT event_id AS query_id, user_id, unnest([event_id % 900, (event_id * 7) % 900]) AS document_id FROM events),
    f AS (SELECT a.*, role, department_id, EXISTS (SELECT 1 FROM assignments s WHERE s.user_id = a.user_id AND s.department_id = d.department_id) AS mine FROM a LEFT JOIN docs d ON d.id = document_id LEFT JOIN users u ON u.id = a.user_id),
    g AS (SELECT query_id, count(document_id) AS requested, count(*) FILTER (department_id IS NOT NULL AND (role = 'SUPER_ADMIN' OR mine)) AS accessible FROM f GROUP BY 1)
    SELECT *, CASE WHEN requested = 0 THEN 'ALL_IN_SCOPE' WHEN requested = accessible THEN 'OK' ELSE 'DOCUMENT_ACCESS_DENIED' END AS outcome FROM g"""))
def requested_docs(spark, sf):
    ids = F.array(F.col("event_id") % 900, (F.col("event_id") * 7) % 900)
    asked = raw(spark, sf, "events").select(F.col("event_id").alias("query_id"), "user_id", ids.alias("document_ids"))
    return access.requested_documents(asked, views.users(spark, sf), views.assignments(spark, sf), views.docs(spark, sf))


@query(with_views("docs", "SELECT id, department_id, created_at FROM docs WHERE status = 'READY' ORDER BY created_at DESC, id LIMIT 20 OFFSET 20"))
def list_documents(spark, sf):
    d = views.docs(spark, sf).filter("status = 'READY'").select("id", "department_id", "created_at")
    return d.orderBy(F.desc("created_at"), "id").offset(20).limit(20)


@query(with_views("users assignments docs departments", """, r AS (SELECT id AS request_id, id AS user_id, role, CASE WHEN id % 4 <> 0 THEN (id * 7) % 25 END AS asked, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'READY' ELSE 'QUEUED' END AS wanted, 1 + id % 2 AS page FROM users),
    s AS (SELECT r.*, d.id AS department_id FROM r, departments d WHERE role = 'SUPER_ADMIN' AND (asked IS NULL OR asked = d.id)
      UNION ALL SELECT r.*, a.department_id FROM r JOIN assignments a USING (user_id) WHERE role <> 'SUPER_ADMIN' AND (asked IS NULL OR asked = a.department_id OR (user_id, asked) NOT IN (SELECT (user_id, department_id) FROM assignments))),
    n AS (SELECT * FROM docs QUALIFY row_number() OVER (PARTITION BY department_id, status ORDER BY created_at DESC, id) <= 40)
    SELECT request_id, n.id, row_number() OVER (PARTITION BY request_id ORDER BY created_at DESC, n.id) AS position, FROM s JOIN n USING (department_id) WHERE wanted IS NULL OR status = wanted
    QUALIFY position > (page - 1) * 20 AND position <= page * 20"""))
def list_by_filters(spark, sf):
    u, id_ = views.users(spark, sf), F.col("id")
    status = F.when(id_ % 3 == 1, "READY").when(id_ % 3 == 2, "QUEUED")
    asked = u.select(id_.alias("request_id"), id_.alias("user_id"), status.alias("status"), F.when(id_ % 4 != 0, (id_ * 7) % 25).alias("department_id"), (1 + id_ % 2).alias("page"))
    return access.filtered_documents(asked, u, views.assignments(spark, sf), views.docs(spark, sf), views.departments(spark, sf), 20)


@query("SELECT l_orderkey AS key, l_linenumber AS line, o_orderkey IS NOT NULL AS found, o_orderstatus AS status FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def key_lookup(spark, sf):
    keys = raw(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"))
    return access.lookup(keys, raw(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")), "key").select("key", "line", "found", "status")


@query(with_views("users assignments", """, t AS (SELECT a.user_id AS actor_id, count(DISTINCT b.user_id) AS targets FROM assignments a JOIN users ua ON ua.id = a.user_id AND ua.role = 'ADMIN' JOIN assignments b USING (department_id) JOIN users ub ON ub.id = b.user_id AND ub.role = 'USER' GROUP BY 1)
    SELECT id, role IN ('SUPER_ADMIN', 'ADMIN') AS may_upload, role IN ('SUPER_ADMIN', 'ADMIN') AS may_manage_users, role IN ('SUPER_ADMIN', 'ADMIN') AS may_read_audit, true AS may_query, coalesce(targets, 0) AS targets FROM users LEFT JOIN t ON actor_id = id"""))
def permission_check(spark, sf):
    u, a = views.users(spark, sf), views.assignments(spark, sf)
    shared = access.may_act_on(u.filter("role = 'ADMIN'"), u.filter("role = 'USER'"), a)
    gates = [access.permission_column(F.col("role"), action).alias(f"may_{action}") for action in access.PERMISSIONS]
    return u.join(shared, F.col("id") == F.col("actor_id"), "left").select("id", *gates, F.coalesce("targets", F.lit(0)).alias("targets"))


@query(with_views("docs", "SELECT id AS document_id, title, filename, status, department_id, owner_user_id, mime_type, size_bytes, created_at FROM docs"))
def proj_documents(spark, sf):
    return views.docs(spark, sf).select(F.col("id").alias("document_id"), "title", "filename", "status", "department_id", "owner_user_id", "mime_type", "size_bytes", "created_at")


@query(with_views("jobs docs", """, l AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT job_id, status, list_position(['QUEUED', 'EXTRACTING', 'CHUNKING', 'EMBEDDING', 'INDEXING', 'COMPLETED'], status) AS step, status = 'FAILED' AS failed, ts AS updated_at FROM l"""))
def proj_jobs(spark, sf):
    last = views.jobs(spark, sf).groupBy("job_id").agg(F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id")).alias("e")).select("job_id", "e.*")
    return last.select("job_id", "status", scalars.job_step(F.col("status")).alias("step"), (F.col("status") == "FAILED").alias("failed"), F.col("ts").alias("updated_at"))


@query(with_views("elements", "SELECT document_id || '-' || page AS element_id, document_id, page, modality AS element_type, coalesce(content, '') AS content, description FROM elements"))
def proj_elements(spark, sf):
    e = views.elements(spark, sf)
    return e.select(F.concat_ws("-", "document_id", "page").alias("element_id"), "document_id", "page", F.col("modality").alias("element_type"), F.coalesce("content", F.lit("")).alias("content"), "description")


@query(with_views("users assignments departments", """SELECT u.id AS user_id, u.email, u.name, u.role, u.status, coalesce(string_agg(d.id, ',' ORDER BY d.id), '') AS department_ids FROM users u LEFT JOIN assignments a ON a.user_id = u.id LEFT JOIN departments d ON d.id = a.department_id GROUP BY ALL"""))
def proj_users(spark, sf):
    held = views.assignments(spark, sf).join(views.departments(spark, sf), F.col("id") == F.col("department_id"), "left_semi").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("department_id")).cast("array<string>"), ",").alias("department_ids"))
    u = views.users(spark, sf).select(F.col("id").alias("user_id"), "email", "name", "role", "status")
    return u.join(held, "user_id", "left").withColumn("department_ids", F.coalesce("department_ids", F.lit("")))


@query(with_views("users", "SELECT event_id AS audit_id, event_type, user_id AS actor_user_id, email AS actor_email, coalesce(props, '{}') AS details_json, ts AS created_at FROM events LEFT JOIN users ON id = user_id"))
def proj_audit(spark, sf):
    u = views.users(spark, sf).select(F.col("id").alias("user_id"), "email")
    e = raw(spark, sf, "events").join(u, "user_id", "left")
    return e.select(F.col("event_id").alias("audit_id"), "event_type", F.col("user_id").alias("actor_user_id"), F.col("email").alias("actor_email"), F.coalesce("props", F.lit("{}")).alias("details_json"), F.col("ts").alias("created_at"))


@query("""SELECT user_id, event_id AS query_id, ts AS created_at, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS position FROM events WHERE event_type = 'view' QUALIFY position <= 50""")
def query_history(spark, sf):
    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), "query_id")
    e = raw(spark, sf, "events").filter("event_type = 'view'").select("user_id", F.col("event_id").alias("query_id"), F.col("ts").alias("created_at"))
    return e.withColumn("position", F.row_number().over(order)).filter("position <= 50")


@query(with_views("docs", "SELECT id, CASE WHEN status IN ('READY', 'COMPLETED') THEN 'done' WHEN status LIKE 'FAILED%' THEN 'failed' ELSE 'in_progress' END AS class FROM docs"))
def status_class(spark, sf):
    return views.docs(spark, sf).select("id", scalars.status_class(F.col("status")).alias("class"))


# --- joins


@query(with_views("users assignments", "SELECT DISTINCT department_id, id, email, role, status FROM assignments JOIN users ON id = user_id"))
def department_users(spark, sf):
    return views.assignments(spark, sf).join(views.users(spark, sf), F.col("id") == F.col("user_id")).select("department_id", "id", "email", "role", "status").distinct()


@query(with_views("users assignments", "SELECT DISTINCT department_id, id, email FROM assignments JOIN users ON id = user_id WHERE role = 'USER' AND status = 'ACTIVE'"))
def active_members(spark, sf):
    u = views.users(spark, sf).filter("role = 'USER' AND status = 'ACTIVE'")
    return views.assignments(spark, sf).join(u, F.col("id") == F.col("user_id")).select("department_id", "id", "email").distinct()


@query(with_views("users assignments docs", """, c AS (SELECT department_id, count(*) AS documents FROM docs WHERE status = 'READY' GROUP BY 1), v AS (SELECT * FROM users WHERE status = 'ACTIVE')
    SELECT user_id, department_id, documents FROM v JOIN assignments ON user_id = id JOIN c USING (department_id) WHERE role <> 'SUPER_ADMIN' UNION ALL SELECT id, department_id, documents FROM v, c WHERE role = 'SUPER_ADMIN'"""))
def active_scope(spark, sf):
    return access.accessible(views.users(spark, sf).filter("status = 'ACTIVE'"), views.assignments(spark, sf), views.docs(spark, sf))


@query(with_views("users assignments departments", """SELECT u.id, u.email, coalesce(string_agg(d.id, ',' ORDER BY d.name), '') AS department_ids, coalesce(string_agg(d.name, ',' ORDER BY d.name), '') AS department_names
    FROM users u LEFT JOIN assignments a ON a.user_id = u.id LEFT JOIN departments d ON d.id = a.department_id WHERE role = 'ADMIN' GROUP BY 1, 2"""))
def admin_listing(spark, sf):
    d = views.departments(spark, sf).select(F.col("id").alias("department_id"), F.col("name").alias("department"))
    a = views.assignments(spark, sf).join(d, "department_id")
    rows = views.users(spark, sf).filter("role = 'ADMIN'").join(a, F.col("id") == F.col("user_id"), "left")
    out = rows.groupBy("id", "email").agg(F.sort_array(F.collect_list(F.when(F.col("department").isNotNull(), F.struct("department", "department_id")))).alias("d"))
    return out.select("id", "email", F.array_join(F.transform("d", lambda x: x["department_id"].cast("string")), ",").alias("department_ids"), F.array_join("d.department", ",").alias("department_names"))


@query(with_views("elements docs", "SELECT document_id, page, coalesce(nullif(title, ''), nullif(filename, ''), substr(document_id::VARCHAR, 1, 8)) AS label, count(*) AS n FROM elements LEFT JOIN docs ON id = document_id GROUP BY ALL"))
def source_labels(spark, sf):
    e = views.elements(spark, sf).select("document_id", "page").join(views.docs(spark, sf).select("id", "title", "filename"), F.col("id") == F.col("document_id"), "left")
    return e.select("document_id", "page", scalars.source_label(F.col("title"), F.col("filename"), F.col("document_id")).alias("label")).groupBy("document_id", "page", "label").agg(F.count("*").alias("n"))


@query(with_views("elements", "SELECT document_id, page, nullif(concat_ws(chr(10) || chr(10), nullif(content, ''), nullif(description, '')), '') AS content, count(*) AS n FROM elements GROUP BY ALL"))
def element_content(spark, sf):
    e = views.elements(spark, sf)
    return e.select("document_id", "page", corpus.element_content(F.col("content"), F.col("description")).alias("content")).groupBy("document_id", "page", "content").agg(F.count("*").alias("n"))


@query(with_views("elements", "SELECT CASE modality WHEN 'text' THEN 'text' WHEN 'table' THEN 'table' WHEN 'picture' THEN 'image' WHEN 'graph' THEN 'graph' ELSE 'other' END AS element_type, count(*) AS n FROM elements GROUP BY 1"))
def element_types(spark, sf):
    return views.elements(spark, sf).groupBy(corpus.element_type(F.col("modality")).alias("element_type")).agg(F.count("*").alias("n"))


# --- windows


@query(with_views("jobs", "SELECT job_id, status, event_id FROM jobs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1"))
def latest_event(spark, sf):
    return views.jobs(spark, sf).groupBy("job_id").agg(F.max_by(F.struct("status", "event_id"), F.struct("ts", "event_id")).alias("e")).select("job_id", "e.*")


@query("SELECT c_custkey AS document_id, o_orderkey AS job_id, o_orderdate AS created_at FROM customer LEFT JOIN orders ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_job(spark, sf):
    last = raw(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.struct(F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("job_id"))).alias("j"))
    return raw(spark, sf, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("document_id"), "j.job_id", "j.created_at")


@query(with_views("jobs", """, o AS (SELECT *, nullif(list_position(['QUEUED', 'EXTRACTING', 'CHUNKING', 'EMBEDDING', 'INDEXING', 'COMPLETED'], status), 0) AS step FROM jobs),
    l AS (SELECT *, lag(step) OVER w AS before, lead(ts) OVER w AS next_ts FROM o WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id))
    SELECT event_id, job_id, status, round((epoch_us(next_ts) - epoch_us(ts)) / 1000000.0, 3) AS seconds, coalesce(step < before, false) AS regression FROM l"""))
def job_steps(spark, sf):
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    j = views.jobs(spark, sf).withColumn("step", scalars.job_step(F.col("status")))
    j = j.withColumn("before", F.lag("step").over(w)).withColumn("next_ts", F.lead("ts").over(w))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return j.select("event_id", "job_id", "status", F.round((micros("next_ts") - micros("ts")) / 1000000.0, 3).alias("seconds"), F.coalesce(F.col("step") < F.col("before"), F.lit(False)).alias("regression"))


@query("SELECT conv_id, turn, text AS question, nxt AS answer FROM (SELECT *, lead(text) OVER w AS nxt, lead(role) OVER w AS nrole FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nrole = 'assistant'")
def qa_pairs(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = raw(spark, sf, "conversations").withColumn("answer", F.lead("text").over(w)).withColumn("next_role", F.lead("role").over(w))
    return c.filter("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


# --- limits and sets


@query("SELECT event_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_audit(spark, sf):
    return raw(spark, sf, "events").select("event_id", "event_type", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)


@query(with_views("departments", "SELECT id, name FROM departments ORDER BY name LIMIT 5"))
def dept_listing(spark, sf):
    return views.departments(spark, sf).orderBy("name").limit(5)


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM (SELECT source, length(text) AS n_chars FROM documents UNION ALL SELECT 'pages', length(html) FROM pages UNION ALL SELECT 'conversations', length(text) FROM conversations) GROUP BY 1")
def corpus_union(spark, sf):
    parts = [raw(spark, sf, "documents").select("source", F.length("text").alias("c")), raw(spark, sf, "pages").select(F.lit("pages").alias("source"), F.length("html").alias("c")), raw(spark, sf, "conversations").select(F.lit("conversations").alias("source"), F.length("text").alias("c"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source").agg(F.count("*").alias("n"), F.sum("c").cast("bigint").alias("n_chars"))


@query(with_views("docs", """SELECT id, format('{:.1f}', round(size_bytes / pow(1024.0, p), 1)) || ' ' || ['B', 'KB', 'MB', 'GB'][p + 1] AS label
    FROM (SELECT *, CASE WHEN size_bytes < 1024 THEN 0 WHEN size_bytes < 1048576 THEN 1 WHEN size_bytes < 1073741824 THEN 2 ELSE 3 END AS p FROM docs)"""))
def format_bytes(spark, sf):
    return views.docs(spark, sf).select("id", scalars.format_bytes(F.col("size_bytes")).alias("label"))


@query(with_views("jobs", "SELECT CASE status WHEN 'COMPLETED' THEN 'READY' WHEN 'FAILED' THEN 'FAILED_INDEXING' ELSE status END AS document_status, count(*) AS n FROM jobs GROUP BY 1"))
def status_map(spark, sf):
    return views.jobs(spark, sf).groupBy(scalars.document_status(F.col("status")).alias("document_status")).agg(F.count("*").alias("n"))
