"""Telemetry-shaped views over the given tables, in Spark and in SQL.

Every view covers all rows of its tables. ``tel`` turns each row of ``events`` into one
probe event, followed by its hop events where the probe is a successful traceroute.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime(2024, 1, 31)

# -- base --------------------------------------------------------------------

BASE_SQL = """base AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INT) AS k,
         CAST(user_id % 15 AS INT) AS a, CAST(floor(user_id / 15) AS INT) AS g,
         CAST(event_id % 7 AS INT) AS m
  FROM events
), named AS (
  SELECT *, concat('agent-', CAST(a AS VARCHAR)) AS agent_id, concat('site-', CAST(a % 5 AS VARCHAR)) AS site_id,
         concat(CASE WHEN g < 3 THEN 'internet-' ELSE 'host-' END, CAST(g AS VARCHAR)) AS target_id,
         CASE m WHEN 0 THEN 'ping' WHEN 1 THEN 'dns' WHEN 2 THEN 'share' WHEN 3 THEN 'internetQuality'
                WHEN 4 THEN 'domainAuth' ELSE 'traceroute' END AS test_type,
         CASE WHEN event_type <> 'error' THEN CASE WHEN m = 2 AND k % 10 = 0 THEN 'EMPTY' ELSE 'SUCCESS' END
              ELSE CASE k % 4 WHEN 0 THEN 'FAILURE' WHEN 1 THEN 'TIMEOUT' WHEN 2 THEN 'FATAL' ELSE 'SKIPPED' END END AS outcome,
         CASE WHEN g = 9 THEN '{"targetKind":"external"}' ELSE '{}' END AS metadata
  FROM base
)"""

TEL_SQL = (
    BASE_SQL
    + """, tel AS (
  SELECT ts AS timestamp_utc, agent_id, site_id, target_id, concat(target_id, '.example.net') AS fqdn,
         concat('10.9.', CAST(a AS VARCHAR), '.', CAST(g AS VARCHAR)) AS target_address, test_type,
         CASE WHEN test_type = 'traceroute' THEN 'Traceroute.Summary' ELSE concat(test_type, '.Primary') END AS probe_name,
         outcome AS result,
         CASE WHEN m IN (0, 3) AND event_type <> 'error' THEN value END AS latency_ms,
         CASE WHEN m = 3 THEN CAST(k % 5 * 25 AS DOUBLE) END AS loss,
         CASE WHEN event_type = 'error' THEN concat('E', CAST(k % 4 AS VARCHAR)) END AS error_code,
         concat('event ', CAST(event_id AS VARCHAR)) AS details,
         CASE WHEN m = 1 THEN '10.0.0.53' END AS dns_server,
         CAST(NULL AS INT) AS hop_index, CAST(NULL AS VARCHAR) AS hop_address, CAST(NULL AS VARCHAR) AS hop_name,
         CAST(NULL AS DOUBLE) AS hop_latency_ms,
         CASE WHEN m >= 5 AND event_type <> 'error' THEN concat('p', CAST(k % 3 AS VARCHAR)) END AS path_hash,
         metadata, event_id, 0 AS seq
  FROM named
  UNION ALL
  SELECT ts, agent_id, site_id, target_id, concat(target_id, '.example.net'),
         concat('10.9.', CAST(a AS VARCHAR), '.', CAST(g AS VARCHAR)), 'traceroute', 'Traceroute.Path', 'INFO',
         CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR), concat('hop ', CAST(h.i AS VARCHAR)), CAST(NULL AS VARCHAR),
         h.i, CASE WHEN h.i <> 3 THEN concat('10.', CAST(k % 3 AS VARCHAR), '.0.', CAST(h.i AS VARCHAR)) END,
         CASE WHEN h.i = 1 THEN 'gw' END, value / h.i,
         CASE WHEN k % 50 <> 0 THEN concat('p', CAST(k % 3 AS VARCHAR)) END, metadata, event_id, h.i
  FROM named CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6)) AS h(i)
  WHERE m >= 5 AND event_type <> 'error' AND h.i <= 3 + k % 3
)"""
)


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the derived numbers every view is built from."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.col("user_id") % 15).cast("int").alias("a"),
        F.floor(F.col("user_id") / 15).cast("int").alias("g"),
        (F.col("event_id") % 7).cast("int").alias("m"),
    )


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rows with agent, site, target, test and outcome."""
    return base(spark, sf_dir).selectExpr(
        "*",
        "concat('agent-', a) AS agent_id",
        "concat('site-', a % 5) AS site_id",
        "concat(if(g < 3, 'internet-', 'host-'), g) AS target_id",
        """CASE m WHEN 0 THEN 'ping' WHEN 1 THEN 'dns' WHEN 2 THEN 'share' WHEN 3 THEN 'internetQuality'
           WHEN 4 THEN 'domainAuth' ELSE 'traceroute' END AS test_type""",
        """CASE WHEN event_type <> 'error' THEN if(m = 2 AND k % 10 = 0, 'EMPTY', 'SUCCESS')
           ELSE CASE k % 4 WHEN 0 THEN 'FAILURE' WHEN 1 THEN 'TIMEOUT' WHEN 2 THEN 'FATAL' ELSE 'SKIPPED' END
           END AS outcome""",
        """if(g = 9, '{"targetKind":"external"}', '{}') AS metadata""",
    )


def tel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical event table: one scan, hop rows made by exploding their numbers."""
    hops = "if(m >= 5 AND event_type <> 'error', 3 + k % 3, 0)"
    return (
        named(spark, sf_dir)
        .selectExpr("*", f"explode(sequence(0, {hops})) AS seq")
        .selectExpr(
            "ts AS timestamp_utc",
            "agent_id",
            "site_id",
            "target_id",
            "concat(target_id, '.example.net') AS fqdn",
            "concat('10.9.', a, '.', g) AS target_address",
            "test_type",
            """CASE WHEN seq > 0 THEN 'Traceroute.Path' WHEN test_type = 'traceroute' THEN 'Traceroute.Summary'
               ELSE concat(test_type, '.Primary') END AS probe_name""",
            "if(seq > 0, 'INFO', outcome) AS result",
            "CASE WHEN m IN (0, 3) AND event_type <> 'error' THEN value END AS latency_ms",
            "CASE WHEN m = 3 THEN CAST(k % 5 * 25 AS DOUBLE) END AS loss",
            "CASE WHEN event_type = 'error' THEN concat('E', k % 4) END AS error_code",
            "if(seq > 0, concat('hop ', seq), concat('event ', event_id)) AS details",
            "CASE WHEN m = 1 THEN '10.0.0.53' END AS dns_server",
            "CASE WHEN seq > 0 THEN seq END AS hop_index",
            "CASE WHEN seq > 0 AND seq <> 3 THEN concat('10.', k % 3, '.0.', seq) END AS hop_address",
            "CASE WHEN seq = 1 THEN 'gw' END AS hop_name",
            "CASE WHEN seq > 0 THEN value / seq END AS hop_latency_ms",
            """CASE WHEN seq = 0 AND m >= 5 AND event_type <> 'error' THEN concat('p', k % 3)
               WHEN seq > 0 AND k % 50 <> 0 THEN concat('p', k % 3) END AS path_hash""",
            "metadata",
            "event_id",
            "seq",
        )
    )


def with_tel(sql: str) -> str:
    return f"WITH {TEL_SQL}\n{sql}"


def with_base(sql: str) -> str:
    return f"WITH {BASE_SQL}\n{sql}"
