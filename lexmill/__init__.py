"""lexmill: department-scoped document retrieval and table maintenance on PySpark."""
