"""Queries that call the table functions from SQL."""

from __future__ import annotations

from kinetable.functions import tables
from kinetable.plans.bindings import table
from kinetable.plans.registry import query


@query("sequence_windows_sql", """WITH n AS (SELECT user_id AS session_id, count(*) AS n FROM events GROUP BY user_id), w AS (SELECT session_id, n, unnest(range(greatest(1, (n - 8) // 2))) AS seq FROM n)
  SELECT session_id, seq, seq * 2 AS start, least(n, seq * 2 + 8) - 1 AS last FROM w""")
def _(spark, sf):
    tables.register(spark)
    counts = table(spark, sf, "events").groupBy("user_id").count().withColumnsRenamed({"user_id": "session_id", "count": "n"})
    return spark.sql("SELECT session_id, seq, start, last FROM {counts}, LATERAL sequence_windows(n, 8, 2)", counts=counts)
