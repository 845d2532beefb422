"""Audit trail, access and workflow-log queries over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import human_bytes
from ..operators import judging as J
from ..operators import records as R
from ..sources.tables import field_names, table
from .phrases import said
from .registry import query

# Which event stands for which action and which status.
ACTION = {"signup": "create", "purchase": "modify", "click": "sign", "error": "delete", "view": "view"}
STATUS = {"signup": "auto", "purchase": "auto", "click": "human", "error": "failed", "view": "skipped"}


def _case(d: dict) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in d.items()) + " END"


def entries(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("record_id"), F.col("event_id").alias("seq"), F.expr(_case(ACTION)).alias("action"), F.col("props").alias("content"))


ENTRIES = f"(SELECT user_id AS record_id, event_id AS seq, {_case(ACTION)} AS action, props AS content FROM events)"


@query(f"""SELECT record_id, seq, content FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY seq DESC) AS k FROM {ENTRIES} WHERE action IN ('create', 'modify', 'delete')) WHERE k = 1 AND action <> 'delete'""")
def current_contents(spark, sf):
    return R.current_content(entries(spark, sf))


@query(f"""WITH e AS (SELECT *, CASE action WHEN 'create' THEN 1 WHEN 'delete' THEN 0 END AS change FROM {ENTRIES}),
b AS (SELECT *, coalesce(last_value(change IGNORE NULLS) OVER (PARTITION BY record_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS before FROM e)
SELECT record_id, seq, action, CASE WHEN action = 'create' THEN NOT before ELSE before END AS legal FROM b""")
def audit_transitions(spark, sf):
    return R.transitions(entries(spark, sf))


@query(f"""SELECT user_id, count(*) FILTER (s = 'auto' AND NOT gate)::BIGINT AS auto, count(*) FILTER (s <> 'skipped' AND NOT gate)::BIGINT AS counted,
  CASE WHEN count(*) FILTER (s <> 'skipped' AND NOT gate) > 0 THEN count(*) FILTER (s = 'auto' AND NOT gate) / count(*) FILTER (s <> 'skipped' AND NOT gate) ELSE 0 END::DOUBLE AS rate
  FROM (SELECT user_id, {_case(STATUS)} AS s, event_id % 10 = 0 AS gate FROM events) GROUP BY user_id""")
def automation_rate(spark, sf):
    log = table(spark, sf, "events").select("user_id", F.expr(_case(STATUS)).alias("status"), (F.col("event_id") % 10 == 0).alias("gate"))
    return R.automation(log, "user_id")


ATTRIBUTES = """element_at(array('recorder', 'reviewer', 'manager', 'viewer', 'agent', 'guest'), cast(user_id % 6 as int) + 1) AS role, {case} AS action, event_id % 7 <> 0 AS in_project,
  event_id % 2 = 0 AS is_owner, element_at(array('draft', 'signed', 'archived'), cast(event_id % 3 as int) + 1) AS state, event_id % 11 = 0 AS sensitive,
  CASE WHEN event_id % 5 = 0 THEN 'api' ELSE 'onprem' END AS location, event_id % 4 = 0 AS retention_expired,
  element_at(array('작성', '확인', '승인', ''), cast(event_id % 4 as int) + 1) AS meaning"""
DUCK = ATTRIBUTES.replace("element_at(array(", "list_extract(list_value(").replace("{case}", _case(ACTION))


@query(f"""SELECT event_id, CASE
  WHEN role = 'guest' THEN false WHEN sensitive AND location = 'api' THEN false
  WHEN role = 'manager' THEN action = 'view' OR (action = 'delete' AND state = 'archived' AND retention_expired)
  WHEN NOT in_project THEN false WHEN action = 'view' THEN true WHEN state = 'archived' OR role = 'viewer' THEN false
  WHEN role = 'agent' THEN action NOT IN ('sign', 'delete') AND state = 'draft'
  WHEN action = 'delete' THEN state = 'draft' AND is_owner WHEN action = 'create' THEN role = 'recorder'
  WHEN action = 'modify' THEN role = 'recorder' AND is_owner
  WHEN role = 'recorder' THEN is_owner AND meaning = '작성' WHEN role = 'reviewer' THEN NOT is_owner AND meaning IN ('확인', '승인') ELSE false END AS allow
  FROM (SELECT event_id, {DUCK} FROM events)""")
def access_decisions(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id", *[x.strip() for x in _split(ATTRIBUTES.format(case=_case(ACTION)))])
    return e.select("event_id", R.allowed().alias("allow"))


def _split(select: str) -> list[str]:
    """Top-level commas of a select list part its items."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(select):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(select[at:k])
            at = k + 1
    return [*out, select[at:]]


@query("SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY 1, 2")
def daily_events(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


CITED = ["Kim et al.", "Smith", "Lee et al", ""]
KNOWN = ["Kim, A.", "B. Smythe", "Lee", "Park"]


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 4 AS n FROM orders) SELECT k, CASE n WHEN 0 THEN 1.0 WHEN 1 THEN round(2 * 4 / 11.0, 9) WHEN 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS author, CASE n WHEN 1 THEN 'author' WHEN 3 THEN 'author,year' ELSE '' END AS mismatches FROM o""")
def author_checks(spark, sf):
    k = F.col("o_orderkey")
    d = table(spark, sf, "orders").select(k.alias("k"), J.author_similarity(said("o_orderkey", CITED), said("o_orderkey", KNOWN)).alias("a"))
    wrong = J.metadata_mismatches(F.lit(0.9), F.col("a"), F.when(F.col("k") % 4 == 3, 0.5).otherwise(1.0))
    return d.select("k", F.round("a", 9).alias("author"), F.array_join(wrong, ",").alias("mismatches"))


@query("""SELECT l_returnflag || '/' || CASE WHEN l_linenumber % 2 = 0 THEN 'kv' ELSE 'prose' END || '/' || CASE WHEN l_quantity > 25 THEN 'phi+' ELSE 'phi-' END || '/' || (['oth-', 'split', 'oth+'])[l_linenumber % 3 + 1] AS stratum, count(*)::BIGINT AS n FROM lineitem GROUP BY 1""")
def review_strata(spark, sf):
    n = F.col("l_linenumber")
    line = F.when(n % 2 == 0, "- key: value").otherwise("a sentence")
    return table(spark, sf, "lineitem").groupBy(J.stratum(F.col("l_returnflag"), line, F.col("l_quantity") > 25, n % 3).alias("stratum")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT unnest(json_keys(props::JSON)) AS name FROM events")
def property_names(spark, sf):
    return field_names(table(spark, sf, "events"), "props")


@query("""SELECT n_nationkey, (['5.0B', '1.5KB', '2.0MB', '3.0GB', '1.0PB'])[n_nationkey % 5 + 1] AS size FROM nation""")
def human_sizes(spark, sf):
    n = F.element_at(F.array(*[F.lit(x) for x in (5, 1536, 2 * 1024**2, 3 * 1024**3, 1024**5)]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return table(spark, sf, "nation").select("n_nationkey", human_bytes(n).alias("size"))
