"""Queries over ``tel``: filters, columns, state, board, paths and drilldown."""

from __future__ import annotations

from datetime import timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import AS_OF, named, tel, with_base, with_tel
from checks.registry import query
from linkscope.functions import events as ev
from linkscope.functions import filters
from linkscope.operators import board, detail, paths, state

DAY = 1440
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
# Target numbers g below 3 have an internet id; metadata makes 9 external.
EXTERNAL = "CASE WHEN g < 3 OR g = 9 THEN 'external' ELSE 'internal' END"
NUMBERED = "tel JOIN (SELECT event_id, g FROM named) USING (event_id)"
KEY = "concat(agent_id, '::', target_id)"
LABEL = "coalesce(hop_name, hop_address, '*')"
NEWEST = "timestamp_utc DESC, event_id DESC, seq DESC"


def _round(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, 6) for c in columns})


# -- projections -------------------------------------------------------------


@query("prj_target_key", with_tel(f"SELECT event_id, seq, {KEY} AS target_key FROM tel"))
def prj_target_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tel(spark, sf_dir).select("event_id", "seq", ev.target_key().alias("target_key"))


# Keys as users might type them: good, without separator, with an empty part, with two separators.
RAW_KEY_SQL = """SELECT event_id, agent_id, target_id, CASE k % 5 WHEN 0 THEN concat(agent_id, target_id)
  WHEN 1 THEN concat('::', target_id) WHEN 2 THEN concat(agent_id, '::')
  WHEN 3 THEN concat(agent_id, '::', target_id, '::x') ELSE concat(agent_id, '::', target_id) END AS target_key, k
  FROM named"""


@query(
    "prj_target_key_split",
    with_base(
        f"""SELECT event_id, target_key, CASE WHEN k % 5 >= 3 THEN agent_id END AS agent_id,
  CASE k % 5 WHEN 3 THEN concat(target_id, '::x') WHEN 4 THEN target_id END AS target_id FROM ({RAW_KEY_SQL})"""
    ),
)
def prj_target_key_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = named(spark, sf_dir).selectExpr(
        "event_id",
        """CASE k % 5 WHEN 0 THEN concat(agent_id, target_id) WHEN 1 THEN concat('::', target_id)
           WHEN 2 THEN concat(agent_id, '::') WHEN 3 THEN concat(agent_id, '::', target_id, '::x')
           ELSE concat(agent_id, '::', target_id) END AS target_key""",
    )
    agent, target = ev.split_target_key("target_key")
    return keys.select("event_id", "target_key", agent.alias("agent_id"), target.alias("target_id"))


@query(
    "prj_target_kind",
    with_tel(
        f"""SELECT event_id, seq, {EXTERNAL} AS target_kind, CASE WHEN g < 3 THEN 'external' ELSE 'internal' END AS prefix_kind FROM {NUMBERED}"""
    ),
)
def prj_target_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tel(spark, sf_dir).select(
        "event_id",
        "seq",
        ev.target_kind().alias("target_kind"),
        ev.target_kind(mode="prefix").alias("prefix_kind"),
    )


@query("prj_hop_label", with_tel(f"SELECT event_id, seq, {LABEL} AS hop_label FROM tel"))
def prj_hop_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tel(spark, sf_dir).select("event_id", "seq", ev.hop_label().alias("hop_label"))


@query(
    "prj_path_hash_default",
    with_tel("SELECT event_id, seq, coalesce(path_hash, 'unknown') AS path_hash FROM tel"),
)
def prj_path_hash_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tel(spark, sf_dir).select("event_id", "seq", ev.path_hash_or_unknown().alias("path_hash"))


@query(
    "prj_metadata_unwrap",
    with_base(
        """SELECT event_id, CASE k % 6 WHEN 0 THEN '{}' WHEN 1 THEN '{}' WHEN 2 THEN '{}'
  WHEN 3 THEN concat('{"hopCount":', CAST(k AS VARCHAR), '}') WHEN 4 THEN '{"metadata":7}' ELSE '{"role":"hop"}' END AS metadata
  FROM named"""
    ),
)
def prj_metadata_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = named(spark, sf_dir).selectExpr(
        "event_id",
        """CASE k % 6 WHEN 0 THEN '{"broken' WHEN 1 THEN '[1, 2]' WHEN 2 THEN CAST(NULL AS STRING)
           WHEN 3 THEN concat('{"metadata": {"hopCount": ', k, '}}') WHEN 4 THEN '{"metadata": 7}'
           ELSE '{"role": "hop"}' END AS metadata""",
    )
    return wrapped.select("event_id", ev.unwrap_metadata().alias("metadata"))


@query(
    "prj_utc",
    with_base(
        """SELECT event_id, CASE k % 3 WHEN 2 THEN date_trunc('second', ts) - INTERVAL 90 MINUTE
  ELSE ts END AS timestamp_utc FROM named"""
    ),
)
def prj_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven-digit fractions with Z, naive text, and a +01:30 offset."""
    texts = named(spark, sf_dir).selectExpr(
        "event_id",
        """CASE k % 3 WHEN 0 THEN concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), '7Z')
           WHEN 1 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS')
           ELSE date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+01:30'") END AS text""",
    )
    return texts.select("event_id", ev.utc_timestamp("text").cast("timestamp_ntz").alias("timestamp_utc"))


@query(
    "prj_event_record",
    with_base(
        """SELECT event_id, CASE WHEN k % 4 > 1 THEN 'E' END AS error_code,
  CASE WHEN k % 3 <> 0 THEN value END AS latency_ms, CASE WHEN k % 5 <> 0 THEN k END AS hop_index FROM named"""
    ),
)
def prj_event_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = named(spark, sf_dir).selectExpr(
        "event_id",
        "CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN ' \\t ' ELSE 'E' END AS error_code",
        "if(k % 3 = 0, double('NaN'), value) AS latency_ms",
        "if(k % 5 = 0, -1, k) AS hop_index",
    )
    return raw.select(
        "event_id",
        ev.blank_to_null("error_code").alias("error_code"),
        ev.nan_to_null("latency_ms").alias("latency_ms"),
        ev.negative_to_null("hop_index").alias("hop_index"),
    )


@query(
    "prj_window_minutes",
    with_base(
        """SELECT event_id, CASE k % 6 WHEN 0 THEN 60 WHEN 1 THEN 120 WHEN 4 THEN 1440 WHEN 5 THEN k + 1 END::BIGINT AS window_minutes
  FROM named"""
    ),
)
def prj_window_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as (minutes, hours): 60/-, -/2, 0/5, -/0, -/-, k+1/9."""
    asked = named(spark, sf_dir).selectExpr(
        "event_id",
        "CASE k % 6 WHEN 0 THEN 60 WHEN 2 THEN 0 WHEN 5 THEN k + 1 END AS minutes",
        "CASE k % 6 WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 3 THEN 0 WHEN 5 THEN 9 END AS hours",
    )
    return asked.select(
        "event_id", filters.window_minutes(F.col("minutes"), F.col("hours")).alias("window_minutes")
    )


@query(
    "prj_status_class",
    with_tel(
        """SELECT event_id, seq, CASE result WHEN 'SUCCESS' THEN 'success' WHEN 'FAILURE' THEN 'failure'
  WHEN 'FATAL' THEN 'failure' WHEN 'TIMEOUT' THEN 'timeout' WHEN 'SKIPPED' THEN 'skipped' WHEN 'EMPTY' THEN 'skipped'
  ELSE 'info' END AS status_class FROM tel"""
    ),
)
def prj_status_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tel(spark, sf_dir).select("event_id", "seq", ev.status_class("result").alias("status_class"))


@query(
    "prj_freshness",
    with_base(
        f"""SELECT event_id, CASE WHEN s < 60 THEN concat(CAST(s AS VARCHAR), 's ago')
  WHEN s < 3600 THEN concat(CAST(s // 60 AS VARCHAR), 'm ago') WHEN s < 86400 THEN concat(CAST(s // 3600 AS VARCHAR), 'h ago')
  ELSE concat(CAST(s // 86400 AS VARCHAR), 'd ago') END AS freshness, s AS age_seconds
  FROM (SELECT event_id, greatest((epoch_us({AS_OF_SQL}) - epoch_us(ts)) // 1000000, 0) AS s FROM named)"""
    ),
)
def prj_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit(AS_OF)
    return named(spark, sf_dir).select(
        "event_id", ev.freshness("ts", as_of).alias("freshness"), ev.age_seconds("ts", as_of).alias("age_seconds")
    )


@query(
    "prj_path_diff",
    with_base(
        """SELECT event_id, ['unknown', 'start', 'length', 'branch', 'start'][k % 5 + 1] AS change, [0, 0, 2, 2, 0][k % 5 + 1] AS shared_hops,
  [1, 2, 3, 4, 1][k % 5 + 1] AS current_hops FROM named"""
    ),
)
def prj_path_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = named(spark, sf_dir).selectExpr(
        "event_id",
        """CASE k % 5 WHEN 0 THEN ' -> ' WHEN 1 THEN 'gw -> x' WHEN 2 THEN concat('gw->', target_id)
           WHEN 3 THEN concat('gw -> ', target_id, ' -> c -> d') ELSE '' END AS previous_path_preview""",
        "'p1' AS previous_path_hash",
        """CASE k % 5 WHEN 0 THEN 'gw' WHEN 1 THEN 'b -> x' WHEN 2 THEN concat('gw -> ', target_id, ' -> c')
           WHEN 3 THEN concat('gw -> ', target_id, ' -> * -> d') ELSE '' END AS path_preview""",
        "'p2' AS path_hash",
    )
    return paths.with_path_diff(pairs).select("event_id", "change", "shared_hops", "current_hops")


# -- filters -----------------------------------------------------------------


@query(
    "flt_window",
    with_tel(f"SELECT event_id, seq, timestamp_utc FROM tel WHERE timestamp_utc >= {AS_OF_SQL} - INTERVAL 10080 MINUTE"),
)
def flt_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same instant as AS_OF, told in another zone."""
    as_of = AS_OF.replace(tzinfo=timezone.utc).astimezone(timezone(timedelta(hours=2)))
    return filters.in_window(tel(spark, sf_dir), as_of, 7 * DAY).select("event_id", "seq", "timestamp_utc")


@query("flt_state_rows", with_tel("SELECT event_id, seq, result FROM tel WHERE result <> 'INFO'"))
def flt_state_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.state_rows(tel(spark, sf_dir)).select("event_id", "seq", "result")


@query(
    "flt_incident", with_tel("SELECT event_id, seq, result FROM tel WHERE result NOT IN ('SUCCESS', 'INFO')")
)
def flt_incident(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.incident_rows(tel(spark, sf_dir)).select("event_id", "seq", "result")


@query(
    "flt_trace_hops",
    with_tel(
        """SELECT event_id, seq, hop_index, path_hash IS NOT NULL AS hashed FROM tel
  WHERE test_type = 'traceroute' AND hop_index IS NOT NULL"""
    ),
)
def flt_trace_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.trace_hop_rows(tel(spark, sf_dir)).select(
        "event_id", "seq", "hop_index", F.col("path_hash").isNotNull().alias("hashed")
    )


@query(
    "flt_trace_visibility",
    with_tel(
        f"SELECT event_id, seq, test_type, {EXTERNAL} AS target_kind FROM {NUMBERED} WHERE g < 3 OR g = 9 OR test_type <> 'traceroute'"
    ),
)
def flt_trace_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tel(spark, sf_dir).withColumn("target_kind", ev.target_kind())
    return filters.visible_tests(rows).select("event_id", "seq", "test_type", "target_kind")


# -- state -------------------------------------------------------------------

# A user of the fixture is one target: agent ``user_id % 15``, target ``user_id // 15``. Expected rows
# are stated from those numbers and from ``k``, ``m`` and ``event_type`` of single events.
LAST_SQL = """last_seen AS (
  SELECT user_id, arg_max(event_id, row(ts, event_id)) AS event_id,
         arg_max(value, row(ts, event_id)) FILTER (WHERE m IN (0, 3) AND event_type <> 'error' AND value IS NOT NULL) AS heard
  FROM named GROUP BY user_id
), newest AS (SELECT n.*, heard FROM last_seen l JOIN named n ON n.event_id = l.event_id)"""
TARGETS_SQL = f"""{LAST_SQL}, targets AS (
  SELECT concat('agent-', a, '::', target_id) AS target_key, target_id, {EXTERNAL} AS target_kind, agent_id,
         concat(target_id, '.example.net') AS fqdn, site_id, concat('10.9.', a, '.', g) AS target_address, test_type AS last_test_type,
         outcome AS latest_result, heard AS last_latency_ms, ts AS last_timestamp_utc FROM newest)"""


def with_targets(sql: str) -> str:
    return with_tel(f", {TARGETS_SQL}\n{sql}")


@query("targets", with_targets("SELECT * FROM targets"))
def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.targets(tel(spark, sf_dir))


@query(
    "win_latest_state",
    with_targets("SELECT agent_id, target_id, outcome AS result, test_type, ts AS timestamp_utc, event_id FROM newest"),
)
def win_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest_state(tel(spark, sf_dir), carry=("result", "test_type", "timestamp_utc", "event_id"))


@query(
    "win_latest_latency",
    with_targets("SELECT agent_id, target_id, heard AS last_latency_ms FROM newest WHERE heard IS NOT NULL"),
)
def win_latest_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest_latency(tel(spark, sf_dir))


@query(
    "win_latest_state_site",
    with_base(f", {LAST_SQL} SELECT site_id, agent_id, target_id, outcome AS result, ts AS timestamp_utc FROM newest"),
)
def win_latest_state_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest_state(tel(spark, sf_dir), state.SITE_TARGET_KEYS)


@query(
    "join_state_latency",
    with_base(f", {LAST_SQL} SELECT agent_id, target_id, outcome AS result, ts AS timestamp_utc, heard AS last_latency_ms FROM newest"),
)
def join_state_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tel(spark, sf_dir)
    return state.join_state_latency(state.latest_state(events), state.latest_latency(events))


@query(
    "join_state_latency_site",
    with_base(
        f", {LAST_SQL} SELECT site_id, agent_id, target_id, outcome AS result, ts AS timestamp_utc, heard AS last_latency_ms FROM newest"
    ),
)
def join_state_latency_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest_state_and_latency(tel(spark, sf_dir), state.SITE_TARGET_KEYS).select(
        *state.SITE_TARGET_KEYS, "result", "timestamp_utc", "last_latency_ms"
    )


@query(
    "win_latest_hop",
    with_tel(
        f"""SELECT agent_id, target_id, coalesce(path_hash, 'unknown') AS path_hash, hop_index, hop_address, timestamp_utc, event_id
  FROM (SELECT *, row_number() OVER (PARTITION BY agent_id, target_id, coalesce(path_hash, 'unknown'), hop_index ORDER BY {NEWEST}) AS rn
  FROM tel WHERE test_type = 'traceroute' AND hop_index IS NOT NULL) WHERE rn = 1"""
    ),
)
def win_latest_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.known_hops(paths.latest_hops(tel(spark, sf_dir))).select(
        *paths.HOP_KEYS, "hop_address", "timestamp_utc", "event_id"
    )


TESTS_SQL = f"""SELECT {KEY} AS target_key, test_type, result AS latest_result, probe_name AS latest_probe_name,
  target_address AS latest_target_address, latency_ms AS last_latency_ms, timestamp_utc AS last_timestamp_utc, event_count
  FROM (SELECT *, count(*) OVER (PARTITION BY agent_id, target_id, test_type) AS event_count,
        row_number() OVER (PARTITION BY agent_id, target_id, test_type ORDER BY {NEWEST}) AS rn
  FROM tel WHERE result <> 'INFO') WHERE rn = 1"""


@query("win_latest_test", with_tel(f"SELECT target_key, test_type, latest_result, last_timestamp_utc FROM ({TESTS_SQL})"))
def win_latest_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detail.tests(tel(spark, sf_dir)).select(
        "target_key", "test_type", "latest_result", "last_timestamp_utc"
    )


@query(
    "win_partition_count",
    with_tel(
        """SELECT event_id, seq, agent_id, target_id, test_type,
  count(*) OVER (PARTITION BY agent_id, target_id, test_type) AS event_count FROM tel WHERE result <> 'INFO'"""
    ),
)
def win_partition_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.state_rows(tel(spark, sf_dir)).select("event_id", "seq", "agent_id", "target_id", "test_type")
    return state.partition_count(rows, ("agent_id", "target_id", "test_type"))


# -- board -------------------------------------------------------------------

# An event counts once, and once more for every hop of its trace; hops are INFO.
HOPS = "CASE WHEN m >= 5 AND event_type <> 'error' THEN 3 + k % 3 ELSE 0 END"
SUMMARY_SQL = f"""SELECT CAST(sum(1 + {HOPS}) AS BIGINT) AS total_events, count(DISTINCT a) AS total_agents, count(DISTINCT user_id) AS total_targets,
  count(DISTINCT a % 5) AS active_sites, CAST(count_if(event_type = 'error' AND k % 2 = 0) AS BIGINT) AS failure_events,
  CAST(count_if(event_type = 'error' AND k % 4 = 1) AS BIGINT) AS timeout_events, max(ts) AS latest_timestamp_utc FROM named"""


@query("fleet_summary", with_base(SUMMARY_SQL))
def fleet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.fleet_summary(tel(spark, sf_dir))


@query(
    "fleet_summary_window",
    with_base(f"{SUMMARY_SQL} WHERE ts >= {AS_OF_SQL} - INTERVAL 1440 MINUTE"),
)
def fleet_summary_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.fleet_summary(tel(spark, sf_dir), AS_OF, DAY)


# How the newest event of a target went, in terms of the fixture.
BAD, LATE = "event_type = 'error' AND k % 2 = 0", "event_type = 'error' AND k % 4 = 1"
AGENTS_SQL = f"""SELECT concat('agent-', a) AS agent_id, concat('site-', a % 5) AS site_id, count(*) AS total_targets,
  CAST(count_if(event_type <> 'error' AND (m <> 2 OR k % 10 > 0)) AS BIGINT) AS healthy_targets, CAST(count_if({BAD}) AS BIGINT) AS failing_targets,
  CAST(count_if({LATE}) AS BIGINT) AS timeout_targets, round(avg(heard), 6) AS average_latency_ms, max(ts) AS last_timestamp_utc
  FROM newest GROUP BY a"""


@query("agents", with_targets(AGENTS_SQL))
def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(board.agents(tel(spark, sf_dir)), "average_latency_ms")


@query(
    "prj_agent_badge",
    with_targets(
        f"SELECT agent_id, CASE WHEN failing_targets > 0 THEN 'FAILURE' ELSE 'SUCCESS' END AS badge FROM ({AGENTS_SQL})"
    ),
)
def prj_agent_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.agents(tel(spark, sf_dir)).select("agent_id", ev.agent_badge("failing_targets").alias("badge"))


@query(
    "sites",
    with_base(
        f""", {LAST_SQL} SELECT concat('site-', a % 5) AS site_id, count(DISTINCT a) AS agent_count, count(*) AS target_count,
  CAST(count_if({BAD} OR {LATE}) AS BIGINT) AS failing_targets, round(avg(heard), 6) AS average_latency_ms, max(ts) AS last_timestamp_utc
  FROM newest GROUP BY a % 5"""
    ),
)
def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(board.sites(tel(spark, sf_dir)), "average_latency_ms")


@query("target_counts", with_targets("SELECT target_kind, count(*) AS target_count FROM targets GROUP BY target_kind"))
def target_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.target_counts(board.targets(tel(spark, sf_dir)))


@query(
    "flt_target_search",
    with_targets(
        """SELECT target_key, latest_result FROM targets WHERE target_kind = 'external' AND latest_result = 'SUCCESS'
  AND lower(concat_ws(' ', fqdn, target_address, agent_id, site_id, target_id)) LIKE '%net-1.exa%'"""
    ),
)
def flt_target_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.search_targets(
        board.targets(tel(spark, sf_dir)), kind="external", status="SUCCESS", text=" NET-1.exa "
    )
    return found.select("target_key", "latest_result")


INCIDENT_COLUMNS = f"{KEY} AS target_key, target_id, fqdn, test_type, result, error_code, details, timestamp_utc"


@query(
    "incidents",
    with_tel(
        f"SELECT {INCIDENT_COLUMNS} FROM tel WHERE result NOT IN ('SUCCESS', 'INFO') ORDER BY {NEWEST} LIMIT 25"
    ),
)
def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.incidents(tel(spark, sf_dir))


# -- paths -------------------------------------------------------------------

# A trace of event k goes through network x = k % 3 and has 3 + x hops; every 50th has no path hash.
ROUTED_SQL = """traced AS (
  SELECT *, CASE WHEN k % 50 = 0 THEN 'unknown' ELSE concat('p', k % 3) END AS path FROM named WHERE m >= 5 AND event_type <> 'error'
), reached AS (
  SELECT user_id, path, i, arg_max(k % 3, row(ts, event_id)) AS x, arg_max(value, row(ts, event_id)) AS v, max(ts) AS seen
  FROM traced JOIN range(1, 6) AS r(i) ON i <= 3 + k % 3 GROUP BY user_id, path, i
), route AS (
  SELECT user_id, path, count(*) AS hops, max(seen) AS seen, round(avg(v / i), 6) AS mean,
         array_to_string(list(CASE i WHEN 1 THEN 'gw' WHEN 3 THEN '*' ELSE concat('10.', x, '.0.', i) END ORDER BY i), ' -> ') AS preview
  FROM reached GROUP BY user_id, path
), who AS (SELECT DISTINCT user_id, agent_id, site_id, target_id, concat(agent_id, '::', target_id) AS target_key, concat(target_id, '.example.net') AS fqdn,
  CASE WHEN g < 3 OR g = 9 THEN 'external' ELSE 'internal' END AS target_kind FROM named)"""
PATHS_SQL = """paths AS (
  SELECT target_key, target_id, target_kind, agent_id, fqdn, path AS path_hash, preview AS path_preview, seen AS last_seen_utc, hops AS hop_count,
         mean AS average_hop_latency_ms FROM route JOIN who USING (user_id))"""
# A change is a path together with the one that was last seen just before it.
CHANGES_SQL = """known AS (SELECT * FROM route WHERE path <> 'unknown'), earlier AS (
  SELECT n.user_id, n.path, max(row(o.seen, o.path, o.preview)) AS old
  FROM known n JOIN known o ON o.user_id = n.user_id AND row(o.seen, o.path) < row(n.seen, n.path) GROUP BY n.user_id, n.path
), lagged AS (
  SELECT target_key, path AS path_hash, seen AS timestamp_utc, old[2] AS previous_path_hash, old[3] AS previous_path_preview,
         preview AS path_preview, hops AS hop_count, target_id, target_kind, fqdn, site_id, agent_id
  FROM known LEFT JOIN earlier USING (user_id, path) JOIN who USING (user_id)
), changes AS (
  SELECT target_key, target_id, target_kind, fqdn, site_id, agent_id, previous_path_hash, previous_path_preview, path_hash, path_preview,
         hop_count, timestamp_utc FROM lagged WHERE previous_path_hash IS NOT NULL)"""


@query("paths", with_tel(f", {ROUTED_SQL}, {PATHS_SQL} SELECT * FROM paths"))
def paths_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(paths.paths(tel(spark, sf_dir)), "average_hop_latency_ms")


@query(
    "agg_ordered_concat",
    with_tel(
        f"""SELECT event_id, string_agg({LABEL}, ' -> ' ORDER BY hop_index) AS path_preview
  FROM tel WHERE hop_index IS NOT NULL GROUP BY event_id"""
    ),
)
def agg_ordered_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route of every single trace."""
    hops = filters.trace_hop_rows(tel(spark, sf_dir)).select(
        "event_id", "hop_index", ev.hop_label().alias("hop_label")
    )
    return paths.ordered_concat(hops, ["event_id"], "hop_label", "hop_index", "path_preview")


@query(
    "win_lag_path",
    with_tel(
        f", {ROUTED_SQL}, {CHANGES_SQL} SELECT target_key, path_hash, timestamp_utc, previous_path_hash, previous_path_preview FROM lagged"
    ),
)
def win_lag_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    sightings = paths.path_sightings(paths.latest_hops(tel(spark, sf_dir)))
    return paths.lag_path(sightings).select(
        "target_key", "path_hash", "timestamp_utc", "previous_path_hash", "previous_path_preview"
    )


@query(
    "path_changes",
    with_tel(f", {ROUTED_SQL}, {CHANGES_SQL} SELECT * FROM changes ORDER BY timestamp_utc DESC, target_key, path_hash LIMIT 25"),
)
def path_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.path_changes(tel(spark, sf_dir))


@query("path_changes_all", with_tel(f", {ROUTED_SQL}, {CHANGES_SQL} SELECT * FROM changes"))
def path_changes_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every transition, without the report's limit."""
    return paths.changes_from_hops(paths.latest_hops(tel(spark, sf_dir)))


@query(
    "join_visible_changes",
    with_targets(
        f""", {ROUTED_SQL}, {CHANGES_SQL} SELECT target_key, path_hash, previous_path_hash, timestamp_utc FROM (SELECT * FROM changes ORDER BY timestamp_utc DESC, target_key, path_hash LIMIT 25) c
  WHERE target_kind = 'external' AND EXISTS (SELECT 1 FROM targets t WHERE t.target_key = c.target_key AND t.site_id = 'site-2')
  ORDER BY timestamp_utc DESC, target_key, path_hash LIMIT 10"""
    ),
)
def join_visible_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tel(spark, sf_dir)
    visible = filters.search_targets(board.targets(events), site="site-2")
    return paths.visible_changes(paths.path_changes(events), visible).select(
        "target_key", "path_hash", "previous_path_hash", "timestamp_utc"
    )


# -- drilldown, for all targets at once --------------------------------------

TIMELINE_SQL = f"""SELECT {KEY} AS target_key, timestamp_utc, latency_ms, result, test_type, event_id, seq
  FROM tel WHERE latency_ms IS NOT NULL QUALIFY row_number() OVER (PARTITION BY agent_id, target_id ORDER BY {NEWEST}) <= 240"""
EVENTS_SQL = f"""SELECT {KEY} AS target_key, timestamp_utc, test_type, probe_name, result, target_address, latency_ms, error_code,
  details, dns_server, path_hash, hop_index, hop_address, metadata, event_id, seq
  FROM tel QUALIFY row_number() OVER (PARTITION BY agent_id, target_id ORDER BY {NEWEST}) <= 80"""


@query("detail_timeline", with_tel(TIMELINE_SQL))
def detail_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detail.timeline(tel(spark, sf_dir))


@query("detail_tests", with_tel(TESTS_SQL))
def detail_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detail.tests(tel(spark, sf_dir))


@query("detail_events", with_tel(EVENTS_SQL))
def detail_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detail.recent_events(tel(spark, sf_dir))


@query(
    "detail_paths",
    with_tel(
        f""", {ROUTED_SQL}, {PATHS_SQL} SELECT * EXCLUDE (agent_id) FROM paths
  QUALIFY row_number() OVER (PARTITION BY target_key ORDER BY last_seen_utc DESC, path_hash) <= 8"""
    ),
)
def detail_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(detail.recent_paths(tel(spark, sf_dir)), "average_hop_latency_ms")


@query(
    "detail_incidents",
    with_tel(
        f"""SELECT {INCIDENT_COLUMNS}, event_id, seq FROM tel WHERE result NOT IN ('SUCCESS', 'INFO')
  QUALIFY row_number() OVER (PARTITION BY agent_id, target_id ORDER BY {NEWEST}) <= 12"""
    ),
)
def detail_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detail.recent_incidents(tel(spark, sf_dir))


def _sample_sql(n: int) -> str:
    return with_tel(
        f""", series AS (SELECT *, row_number() OVER (PARTITION BY target_key ORDER BY timestamp_utc, event_id, seq) - 1 AS r,
       count(*) OVER (PARTITION BY target_key) AS n FROM ({TIMELINE_SQL}))
  SELECT target_key, timestamp_utc, latency_ms, result, test_type, event_id, seq FROM series WHERE n <= {n}
     OR r IN (SELECT CAST(floor((i / {n - 1}.0::DOUBLE) * (n - 1) + 0.5) AS BIGINT) FROM range({n}) AS g(i))"""
    )


@query("detail_sample", _sample_sql(48))
def detail_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detail.sample_series(detail.timeline(tel(spark, sf_dir)))


@query("detail_sample_short", _sample_sql(6))
def detail_sample_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six points, so that short series are thinned too."""
    return detail.sample_series(detail.timeline(tel(spark, sf_dir)), 6)


@query(
    "recent_event_feed",
    with_targets(
        f"""SELECT e.target_key, e.test_type, e.timestamp_utc, e.event_id, e.seq FROM ({EVENTS_SQL}) e JOIN targets t ON t.target_key = e.target_key
  WHERE t.target_kind = 'external' OR e.test_type <> 'traceroute'
  QUALIFY row_number() OVER (PARTITION BY e.target_key ORDER BY e.timestamp_utc DESC, e.event_id DESC, e.seq DESC) <= 20"""
    ),
)
def recent_event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tel(spark, sf_dir)
    feed = detail.event_feed(detail.recent_events(events), board.targets(events))
    return feed.select("target_key", "test_type", "timestamp_utc", "event_id", "seq")


DETAIL_KEY = "agent-4::internet-1"
ONE = f"agent_id = 'agent-4' AND target_id = 'internet-1' AND timestamp_utc >= {AS_OF_SQL} - INTERVAL 20160 MINUTE"


@query(
    "target_detail",
    with_targets(
        f""", one AS (SELECT * FROM tel WHERE {ONE})
  SELECT * FROM (SELECT 'target' AS section, last_test_type AS item, latest_result AS result, last_timestamp_utc AS seen_utc FROM targets WHERE target_key = '{DETAIL_KEY}')
  UNION ALL SELECT * FROM (SELECT 'latency_series', test_type, result, timestamp_utc FROM one WHERE latency_ms IS NOT NULL ORDER BY {NEWEST} LIMIT 240)
  UNION ALL SELECT * FROM (SELECT 'tests', test_type, result, timestamp_utc FROM one WHERE result <> 'INFO'
    QUALIFY row_number() OVER (PARTITION BY test_type ORDER BY {NEWEST}) = 1)
  UNION ALL SELECT * FROM (SELECT 'recent_events', test_type, result, timestamp_utc FROM one ORDER BY {NEWEST} LIMIT 80)
  UNION ALL SELECT * FROM (SELECT 'paths', coalesce(path_hash, 'unknown'), 'INFO', max(timestamp_utc) AS seen_utc FROM one
    WHERE test_type = 'traceroute' AND hop_index IS NOT NULL GROUP BY 2 ORDER BY seen_utc DESC LIMIT 8)
  UNION ALL SELECT * FROM (SELECT 'incidents', test_type, result, timestamp_utc FROM one WHERE result NOT IN ('SUCCESS', 'INFO') ORDER BY {NEWEST} LIMIT 12)"""
    ),
)
def target_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six frames of one target over two weeks, stacked."""
    frames = detail.target_detail(tel(spark, sf_dir), DETAIL_KEY, AS_OF, 14 * DAY)
    columns = {
        "target": ("last_test_type", "latest_result", "last_timestamp_utc"),
        "tests": ("test_type", "latest_result", "last_timestamp_utc"),
        "paths": ("path_hash", None, "last_seen_utc"),
    }
    stacked = None
    for name, frame in frames.items():
        item, result, at = columns.get(name, ("test_type", "result", "timestamp_utc"))
        part = frame.select(
            F.lit(name).alias("section"),
            F.col(item).alias("item"),
            (F.col(result) if result else F.lit("INFO")).alias("result"),
            F.col(at).alias("seen_utc"),
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked
