"""List views and dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark.operators import stats
from workload.registry import query
from workload.tables import Tables, as_of
from workload.views import AS_OF

# The events of the last five days before the fixed instant.
HOURS = 120
_RECENT = f"timestamp_ >= TIMESTAMP '{AS_OF}' - INTERVAL {HOURS} HOUR"
_LOG = "id, project_id, timestamp_, actor_id, resource_urn, action, decision"


def _log(t: Tables) -> DataFrame:
    return t.audit_log().withColumn("reason_trace", F.coalesce("reason_trace", F.lit("{}")))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", "project_id", F.col("timestamp").alias("timestamp_"), "actor_id", "resource_urn", "action", "decision")


@query("p1_list_audit", f"SELECT {_LOG} FROM v_audit_log WHERE project_id = 'p1' ORDER BY timestamp_ DESC, id LIMIT 50")
def p1_list_audit(t: Tables) -> DataFrame:
    return _shown(stats.list_audit(t.audit_log(), "p1"))


@query("p1_list_audit_by_actor", f"SELECT {_LOG} FROM v_audit_log WHERE project_id = 'p1' AND actor_id = 'user_1' ORDER BY timestamp_ DESC, id LIMIT 20")
def p1_list_audit_by_actor(t: Tables) -> DataFrame:
    return _shown(stats.list_audit(t.audit_log(), "p1", limit=20, actor="user_1"))


@query("p5_decision_filter", f"SELECT * FROM (SELECT {_LOG} FROM v_audit_log WHERE project_id = 'p2' AND decision = 'DENY' ORDER BY timestamp_ DESC, id LIMIT 50)")
def p5_decision_filter(t: Tables) -> DataFrame:
    return _shown(stats.list_audit(t.audit_log(), "p2", decision="DENY"))


@query("p2_search", """SELECT id, title, enforcement_level FROM v_obligations
WHERE is_active AND enforcement_level = 2 AND (title ILIKE '%pur%' OR id ILIKE '%pur%')""")
def p2_search(t: Tables) -> DataFrame:
    return stats.search_obligations(t.obligations(), "pUR", level=2).select("id", "title", "enforcement_level")


@query("p2_search_inactive", "SELECT id, title, is_active FROM v_obligations WHERE title ILIKE '%ob-s1%' OR id ILIKE '%ob-s1%'")
def p2_search_inactive(t: Tables) -> DataFrame:
    return stats.search_obligations(t.obligations(), "OB-S1", include_inactive=True).select("id", "title", "is_active")


@query("p3_page", "SELECT project_id, urn, name FROM v_resources ORDER BY urn LIMIT 500 OFFSET 500")
def p3_page(t: Tables) -> DataFrame:
    return stats.page(t.resources(), 2, 500, ["urn"])[0].select("project_id", "urn", "name")


# A page far behind: ranges are counted until few rows are left to sort.
@query("p3_deep_page", f"SELECT {_LOG} FROM v_audit_log ORDER BY timestamp_ NULLS FIRST, id LIMIT 100 OFFSET 7300")
def p3_deep_page(t: Tables) -> DataFrame:
    return _shown(stats.page(t.audit_log(), 74, 100, ["timestamp", "id"], max_sorted=500)[0])


@query("p3_page_after", "SELECT project_id, urn, name FROM v_resources WHERE project_id > 'p1' OR (project_id = 'p1' AND urn > 'urn:m') ORDER BY project_id, urn LIMIT 200")
def p3_page_after(t: Tables) -> DataFrame:
    return stats.page_after(t.resources(), ("p1", "urn:m"), 200, ["project_id", "urn"]).select("project_id", "urn", "name")


@query("p3_page_total", "SELECT count(*) AS total, CAST(ceil(count(*) / 30.0) AS BIGINT) AS pages FROM v_resources")
def p3_page_total(t: Tables) -> DataFrame:
    return stats.page(t.resources(), 0, 30, ["urn"])[1]


@query("p4_high_risk", """SELECT urn, CASE WHEN name = '' THEN string_split(urn, ':')[-1] ELSE name END AS name FROM v_resources_raw
WHERE upper(json_extract_string(attributes, '$.sensitivity')) IN ('CONFIDENTIAL', 'RESTRICTED', '3', '4')
   OR json_extract_string(attributes, '$.risk_level') IN ('HIGH', 'UNACCEPTABLE', '3', '4')
   OR lower(json_extract_string(attributes, '$.tags.sensitivity')) IN ('high', 'restricted') ORDER BY urn LIMIT 200""")
def p4_high_risk(t: Tables) -> DataFrame:
    return stats.high_risk(t.view("v_resources_raw"), 200).select("urn", "name")


@query("g1a_kpis", f"""WITH a AS (SELECT project_id, count(*) AS total, count(*) FILTER (WHERE decision = 'DENY') AS denials FROM v_audit_log WHERE {_RECENT} GROUP BY ALL),
r AS (SELECT project_id, count(*) AS resources FROM v_resources GROUP BY ALL), o AS (SELECT project_id, count(*) AS n FROM v_obligations WHERE is_active AND project_id IS NOT NULL GROUP BY ALL)
SELECT project_id, coalesce(total, 0) AS total_requests, coalesce(denials, 0) AS denials, coalesce(n, 0) + (SELECT count(*) FROM v_obligations WHERE is_active AND project_id IS NULL) AS active_obligations, coalesce(resources, 0) AS resources,
  CASE WHEN coalesce(total, 0) = 0 THEN 100.0 ELSE round(CAST((total - denials) * 1.0 / total * 100 AS DOUBLE), 1) END AS enforcement_rate
FROM r FULL JOIN o USING (project_id) FULL JOIN a USING (project_id)""")
def g1a_kpis(t: Tables) -> DataFrame:
    return stats.kpis(t.audit_log(), t.obligations(), t.resources(), as_of(), HOURS)


@query("g1b_traffic", f"""SELECT project_id, date_trunc('hour', timestamp_) AS hour, count(*) FILTER (WHERE decision = 'ALLOW') AS allowed,
  count(*) FILTER (WHERE decision = 'DENY') AS denied FROM v_audit_log WHERE {_RECENT} GROUP BY ALL""")
def g1b_traffic(t: Tables) -> DataFrame:
    return stats.traffic_series(t.audit_log(), as_of(), HOURS)


_REASONS = f"""reasons AS (SELECT CASE WHEN event_id % 5 = 4 THEN 'Unspecified Policy' ELSE coalesce(reason, 'Unspecified Policy') END AS reason, count(*) AS denials
  FROM v_audit_log WHERE decision = 'DENY' AND {_RECENT} GROUP BY 1)"""


@query("g1c_top_reasons", f"WITH {_REASONS} SELECT * FROM reasons ORDER BY denials DESC, reason LIMIT 5")
def g1c_top_reasons(t: Tables) -> DataFrame:
    return stats.top_deny_reasons(_log(t), as_of(), HOURS)


@query("g1d_recent_blocks", f"SELECT {_LOG} FROM v_audit_log WHERE decision = 'DENY' ORDER BY timestamp_ DESC, id LIMIT 10")
def g1d_recent_blocks(t: Tables) -> DataFrame:
    return _shown(stats.recent_blocks(t.audit_log()))


@query("g1e_inventory_kpis", """SELECT project_id, count(*) AS total, count(DISTINCT platform) AS platforms, 100 AS tag_coverage,
  count(*) FILTER (WHERE sensitivity >= 3 OR risk_level >= 3) AS risk_count FROM v_resources GROUP BY project_id""")
def g1e_inventory_kpis(t: Tables) -> DataFrame:
    return stats.inventory_kpis(t.resources())


_JOBS = """SELECT 'job-' || o_orderkey AS job_id, CASE o_orderkey % 5 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'COMPLETED' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'PROCESSING' ELSE 'COMPLETED' END AS status FROM orders"""


def _jobs(t: Tables) -> DataFrame:
    t.base("orders")
    return t.spark.sql(_JOBS)


@query("g1f_job_board", f"WITH j AS ({_JOBS}) SELECT job_id, status FROM j ORDER BY CASE WHEN status IN ('COMPLETED', 'FAILED') THEN 1 ELSE 0 END, job_id LIMIT 50")
def g1f_job_board(t: Tables) -> DataFrame:
    return stats.job_board(_jobs(t))[0]


@query("g1f_jobs_pending", f"WITH j AS ({_JOBS}) SELECT count(*) FILTER (WHERE status NOT IN ('COMPLETED', 'FAILED')) AS pending FROM j")
def g1f_jobs_pending(t: Tables) -> DataFrame:
    return stats.job_board(_jobs(t))[1]


@query("g1g_reason_share", f"WITH {_REASONS} SELECT *, round(CAST(denials AS DOUBLE) / sum(denials) OVER () * 100, 1) AS share FROM reasons")
def g1g_reason_share(t: Tables) -> DataFrame:
    return stats.reason_share(stats.deny_reasons(_log(t), as_of(), HOURS))
