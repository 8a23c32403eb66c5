"""Queries over captured probe output, extensions and inventory tags.

Every row of ``events`` stands for one run of the probe at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.fixtures import named, with_base
from checks.registry import query
from linkscope.operators import extensions, inventory, probes

RUN = (
    "event_id AS run_id",
    "agent_id",
    "site_id",
    "target_id",
    "concat(target_id, '.example.net') AS fqdn",
    "concat('10.9.', a, '.', g) AS target_address",
    "ts AS captured_utc",
)


def _runs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return named(spark, sf_dir).selectExpr(*RUN, *columns)


def _lines(spark: SparkSession, sf_dir: str, last: str, line: str) -> DataFrame:
    """Lines 0 to ``last`` of each run; null lines are left out."""
    numbered = named(spark, sf_dir).selectExpr("*", f"explode(sequence(0, {last})) AS line_no")
    return numbered.selectExpr("event_id AS run_id", "line_no", f"{line} AS line").filter("line IS NOT NULL")


def _outcomes(events: DataFrame, *columns: str) -> DataFrame:
    return events.select("run_id", "result", "error_code", "details", *columns)


# -- traceroute --------------------------------------------------------------

LAST_HOP = "CASE WHEN event_type <> 'error' THEN 3 + k % 3 ELSE 0 END"


def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header, a named gateway, plain hops, silent hops and a ``<1 ms`` hop."""
    return _lines(
        spark,
        sf_dir,
        LAST_HOP,
        """CASE WHEN line_no = 0 THEN 'traceroute to target, 30 hops max'
           WHEN line_no = 1 THEN concat(' 1  gw-', a, '.example.net (10.', k % 3, '.0.1)  ', k, '.25 ms  ', k + 1, '.50 ms')
           WHEN line_no = 3 AND k % 2 = 0 THEN '3  *  *  *'
           WHEN line_no = 4 THEN concat('4    <1 ms     1 ms     1 ms  10.', k % 3, '.0.4')
           ELSE concat(line_no, '  10.', k % 3, '.0.', line_no, '  ', k, '.25 ms') END""",
    )


def trace_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(
        spark,
        sf_dir,
        "k % 40 = 0 AS tool_missing",
        "CASE WHEN k % 40 = 1 THEN 'boom' END AS error_text",
        "k % 40 = 2 AS timed_out",
    )


HOPS_SQL = f"""hops AS (
  SELECT event_id AS run_id, CAST(i AS INT) AS line_no, CAST(i AS INT) AS hop_index, k, a, CASE WHEN NOT (i = 3 AND k % 2 = 0) THEN concat('10.', CAST(k % 3 AS VARCHAR), '.0.', CAST(i AS VARCHAR)) END AS hop_address,
         CASE WHEN i = 1 THEN concat('gw-', CAST(a AS VARCHAR), '.example.net') END AS hop_name,
         CASE WHEN i = 3 AND k % 2 = 0 THEN NULL WHEN i = 4 THEN 1.0 ELSE k + 0.25 END::DOUBLE AS hop_latency_ms
  FROM named CROSS JOIN range(1, 6) AS r(i) WHERE i <= {LAST_HOP}
), hashes AS (
  SELECT run_id, substr(sha256(string_agg(concat(CAST(hop_index AS VARCHAR), ':', coalesce(hop_address, '')), '|' ORDER BY line_no)), 1, 16) AS path_hash, count(*) AS hop_count
  FROM hops GROUP BY run_id
), outcomes AS (
  SELECT event_id AS run_id, path_hash, hop_count, CASE WHEN k % 40 = 0 THEN 'SKIPPED' WHEN k % 40 = 1 THEN 'FATAL' WHEN k % 40 = 2 THEN 'TIMEOUT' WHEN hop_count IS NULL THEN 'FAILURE' ELSE 'SUCCESS' END AS result,
    CASE WHEN k % 40 = 0 THEN 'TracerouteMissing' WHEN k % 40 = 1 THEN 'TracerouteFailure' WHEN k % 40 = 2 THEN 'TracerouteTimeout' WHEN hop_count IS NULL THEN 'NoPathData' END AS error_code,
    CASE WHEN k % 40 = 0 THEN 'traceroute command is not available on this host.' WHEN k % 40 = 1 THEN 'boom' WHEN k % 40 = 2 THEN 'Traceroute exceeded 20 seconds.'
      WHEN hop_count IS NULL THEN 'Traceroute completed but no hop data was parsed.' ELSE concat('Traceroute completed with ', CAST(hop_count AS VARCHAR), ' hops.') END AS details
  FROM named LEFT JOIN hashes ON run_id = event_id
)"""


@query("trace_hops", with_base(f", {HOPS_SQL} SELECT run_id, line_no, hop_index, hop_address, hop_name, hop_latency_ms FROM hops"))
def trace_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.trace_hops(trace_lines(spark, sf_dir)).drop("details")


@query("trace_path_hash", with_base(f", {HOPS_SQL} SELECT run_id, path_hash, hop_count FROM hashes"))
def trace_path_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.trace_path_hashes(probes.trace_hops(trace_lines(spark, sf_dir)))


@query(
    "trace_summary",
    with_base(
        f""", {HOPS_SQL} SELECT run_id, path_hash, hop_count, 'SUCCESS' AS result, concat('Traceroute completed with ', CAST(hop_count AS VARCHAR), ' hops.') AS details,
  concat('{{"role":"summary","hopCount":', CAST(hop_count AS VARCHAR), '}}') AS metadata FROM hashes"""
    ),
)
def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.trace_summary(probes.trace_path_hashes(probes.trace_hops(trace_lines(spark, sf_dir))))


@query("trace_outcome", with_base(f", {HOPS_SQL} SELECT * FROM outcomes"))
def trace_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = probes.trace_path_hashes(probes.trace_hops(trace_lines(spark, sf_dir)))
    return _outcomes(probes.trace_outcome(trace_runs(spark, sf_dir), hashes), "path_hash", "hop_count")


@query(
    "trace_events",
    with_base(
        f""", {HOPS_SQL} SELECT o.run_id, 'Traceroute.Path' AS probe_name, 'INFO' AS result, hop_index, hop_address, path_hash, '{{"role":"hop"}}' AS metadata
  FROM outcomes o JOIN hops h ON h.run_id = o.run_id WHERE o.result = 'SUCCESS'
  UNION ALL SELECT run_id, CASE WHEN result = 'SUCCESS' THEN 'Traceroute.Summary' ELSE 'Traceroute.Path' END, result, NULL, NULL, CASE WHEN result = 'SUCCESS' THEN path_hash END,
    CASE WHEN result = 'SUCCESS' THEN concat('{{"role":"summary","hopCount":', CAST(hop_count AS VARCHAR), '}}') ELSE '{{}}' END FROM outcomes"""
    ),
)
def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = probes.trace_events(trace_runs(spark, sf_dir), trace_lines(spark, sf_dir))
    return events.select("run_id", "probe_name", "result", "hop_index", "hop_address", "path_hash", "metadata")


# -- ping, quality, dns ------------------------------------------------------


@query(
    "ping_events",
    with_base(
        """SELECT event_id AS run_id, CASE WHEN k % 30 = 29 THEN 'FATAL' WHEN event_type = 'error' THEN 'FAILURE' ELSE 'SUCCESS' END AS result,
  CASE WHEN k % 30 = 29 THEN 'NativePingException' WHEN event_type = 'error' THEN 'NativePingFailure' END AS error_code,
  CASE WHEN k % 30 = 29 THEN 'boom' WHEN event_type = 'error' THEN concat('PING ', target_id, chr(10), chr(10), 'rtt ', CAST(k AS VARCHAR))
       ELSE concat('rtt ', CAST(k AS VARCHAR), ' ') END AS details,
  CASE WHEN k % 30 <> 29 AND event_type <> 'error' THEN CASE WHEN k % 10 = 0 THEN 0 ELSE k + 0.5 END END::DOUBLE AS latency_ms FROM named"""
    ),
)
def ping_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(
        spark,
        sf_dir,
        "3",
        """CASE line_no WHEN 0 THEN concat(' PING ', target_id) WHEN 1 THEN ''
           WHEN 2 THEN CASE WHEN event_type <> 'error' AND k % 10 <> 0 THEN concat('64 bytes: icmp_seq=1 Time=', k, '.5 ms; time=9 ms') END
           ELSE concat('rtt ', k, ' ') END""",
    )
    runs = _runs(
        spark, sf_dir, "if(event_type = 'error', 1, 0) AS exit_code", "CASE WHEN k % 30 = 29 THEN 'boom' END AS error_text"
    )
    return _outcomes(probes.ping_events(runs, lines), "latency_ms")


@query(
    "internet_quality",
    with_base(
        """, samples AS (SELECT event_id AS run_id, CASE WHEN (k + n) % 5 <> 0 AND k % 10 <> 3 THEN value + n END AS latency_ms
  FROM named CROSS JOIN range(1, 5) AS r(n)), sets AS (SELECT run_id, count(*) AS samples, count(latency_ms) AS good, avg(latency_ms) AS mean FROM samples GROUP BY run_id)
  SELECT run_id, round(mean, 6) AS latency_ms, (samples - good) / samples * 100 AS loss, CASE WHEN good = 0 THEN 'FAILURE' ELSE 'SUCCESS' END AS result,
    CASE WHEN good = 0 THEN 'AllSamplesFailed' END AS error_code, CASE WHEN good = 0 THEN 'Every sample failed.' ELSE concat('Average latency ',
    format('{:,.2f}', CASE WHEN mean * 8 = floor(mean * 8) AND mean * 4 <> floor(mean * 4) THEN mean + 0.0001 ELSE mean END), ' ms across ',
    CAST(good AS VARCHAR), '/', CAST(samples AS VARCHAR), ' successful samples.') END AS details FROM sets"""
    ),
)
def internet_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = named(spark, sf_dir).selectExpr("*", "explode(sequence(1, 4)) AS n").selectExpr(
        "event_id AS run_id", "CASE WHEN (k + n) % 5 <> 0 AND k % 10 <> 3 THEN value + n END AS latency_ms"
    )
    return probes.internet_quality(samples).withColumn("latency_ms", F.round("latency_ms", 6))


@query(
    "dns_events",
    with_base(
        """SELECT event_id AS run_id, '10.0.0.53' AS dns_server, CASE WHEN event_type <> 'error' OR k % 4 = 1 THEN 'SUCCESS' WHEN k % 2 = 0 THEN 'FAILURE' ELSE 'FATAL' END AS result,
  CASE WHEN event_type <> 'error' OR k % 4 = 1 THEN NULL WHEN k % 2 = 0 THEN 'NoAddress' ELSE 'DnsQueryFailure' END AS error_code,
  CASE WHEN event_type = 'error' THEN CASE k % 4 WHEN 0 THEN concat(' ;; timed out', chr(10), ';; no servers') WHEN 1 THEN 'Resolved to 10.0.0.53'
         WHEN 2 THEN 'DNS query returned no address.' ELSE 'Cannot index into a null array.' END
       WHEN k % 2 = 0 THEN concat('Resolved to 10.0.', CAST(k AS VARCHAR), '.1') ELSE concat('Resolved to 10.1.', CAST(k AS VARCHAR), '.1') END AS details FROM named"""
    ),
)
def dns_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(
        spark,
        sf_dir,
        "3",
        """CASE WHEN k % 2 = 0 AND event_type <> 'error' THEN CASE line_no WHEN 0 THEN 'alias.example.net.' WHEN 1 THEN concat(' 10.0.', k, '.1 ') WHEN 2 THEN 'fe80::1' END
           WHEN k % 4 = 0 THEN CASE line_no WHEN 0 THEN ' ;; timed out' WHEN 1 THEN ' ' WHEN 2 THEN ';; no servers' END
           WHEN k % 4 = 2 THEN CASE line_no WHEN 0 THEN '' END
           WHEN k % 4 = 3 AND event_type = 'error' THEN CASE line_no WHEN 0 THEN 'server can''t find it' END
           ELSE CASE line_no WHEN 0 THEN 'Server:  ns' WHEN 1 THEN 'address:  10.0.0.53#53'
             ELSE CASE WHEN event_type <> 'error' THEN if(line_no = 2, 'Name: x', concat('Address: 10.1.', k, '.1')) END END END""",
    )
    runs = _runs(
        spark,
        sf_dir,
        "if(k % 2 = 0, 'dig', 'nslookup') AS tool",
        "'10.0.0.53' AS dns_server",
        "CAST(NULL AS STRING) AS error_text",
    )
    return _outcomes(probes.dns_events(runs, lines), "dns_server")


# -- shares and authentication -----------------------------------------------

SHARE_SQL = """SELECT event_id AS run_id, CASE WHEN k % 12 = 0 THEN 'SKIPPED' WHEN k % 12 = 1 THEN 'FATAL' WHEN m = 6 THEN CASE WHEN k % 12 = 4 THEN 'TIMEOUT' WHEN event_type = 'view' THEN 'EMPTY' ELSE 'SUCCESS' END
    WHEN k % 12 = 2 THEN 'SKIPPED' WHEN k % 12 = 3 AND m = 1 THEN 'SKIPPED' WHEN k % 12 = 4 THEN 'TIMEOUT' WHEN m = 1 AND k % 12 = 5 THEN 'FAILURE' WHEN event_type = 'error' THEN 'FAILURE'
    WHEN event_type = 'view' THEN 'EMPTY' ELSE 'SUCCESS' END AS result,
  CASE WHEN k % 12 = 0 THEN 'NoSharesConfigured' WHEN k % 12 = 1 THEN CASE WHEN g % 2 = 0 THEN 'LinuxProfileNotFound' ELSE 'ShareProbeFailure' END WHEN m = 6 THEN CASE WHEN k % 12 = 4 THEN 'ShareTimeout' END
    WHEN k % 12 = 2 THEN 'SmbClientMissing' WHEN k % 12 = 3 AND m = 1 THEN 'LinuxKinitMissing' WHEN k % 12 = 4 THEN 'ShareTimeout' WHEN m = 1 AND k % 12 = 5 THEN 'LinuxKerberosAcquireFailed'
    WHEN event_type = 'error' THEN 'LinuxShareAccessFailed' END AS error_code,
  CASE WHEN k % 12 = 0 THEN 'Target has no configured shares.' WHEN k % 12 = 1 THEN 'boom' WHEN m = 6 THEN CASE WHEN k % 12 = 4 THEN 'Share probe exceeded 15 seconds.' WHEN event_type = 'view' THEN 'Share probe succeeded but returned no visible items.' ELSE 'Share access confirmed.' END
    WHEN k % 12 = 2 THEN 'smbclient is required for Linux share probes.' WHEN k % 12 = 3 AND m = 1 THEN 'kinit is required for keytab-backed Linux share probes.' WHEN k % 12 = 4 THEN 'Share probe exceeded 15 seconds.'
    WHEN m = 1 AND k % 12 = 5 THEN 'Kerberos ticket acquisition failed for the Linux share probe.' WHEN event_type = 'error' THEN concat('smbclient returned exit code ', CAST(g + 1 AS VARCHAR), '.')
    WHEN event_type = 'view' THEN 'Share probe succeeded but returned no visible items.' ELSE 'Share access confirmed.' END AS details,
  CASE WHEN k % 12 = 0 THEN '{}' WHEN m = 1 THEN concat('{"shareId":"s', CAST(g AS VARCHAR), '","sharePath":"//srv/s","linuxProfileId":"p1"}') ELSE concat('{"shareId":"s', CAST(g AS VARCHAR), '","sharePath":"//srv/s"}') END AS metadata FROM named"""


@query("share_events", with_base(SHARE_SQL))
def share_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(
        spark,
        sf_dir,
        "CASE WHEN k % 12 <> 0 THEN concat('s', g) END AS share_id",
        "CASE WHEN k % 12 <> 0 THEN '//srv/s' END AS share_path",
        "if(m = 6, 'windows', 'linux') AS platform",
        "if(m = 1, 'p1', '') AS profile_id",
        "if(m = 1, 'kerberosKeytab', 'currentContext') AS profile_mode",
        "k % 12 <> 2 AS has_smbclient",
        "k % 12 <> 3 AS has_kinit",
        "if(k % 12 = 5, 1, 0) AS kinit_exit_code",
        "if(event_type = 'error', g + 1, 0) AS exit_code",
        "k % 12 = 4 AS timed_out",
        "CASE WHEN k % 12 = 1 AND g % 2 = 0 THEN 'LinuxProfileNotFound' END AS error_code",
        "CASE WHEN k % 12 = 1 THEN 'boom' END AS error_text",
    )
    lines = _lines(spark, sf_dir, "1", "CASE WHEN event_type <> 'view' AND line_no = 1 THEN 'Disk|s' ELSE ' ' END")
    return _outcomes(probes.share_events(runs, lines), "metadata")


@query(
    "auth_events",
    with_base(
        """, runs AS (SELECT *, CASE WHEN m = 1 THEN 'kerberosKeytab' WHEN m = 2 THEN 'usernamePassword' ELSE 'currentContext' END AS mode FROM named)
  SELECT event_id AS run_id, CASE WHEN m = 6 THEN 'SKIPPED' WHEN k % 12 = 1 THEN 'FATAL' WHEN m = 2 THEN 'SKIPPED' WHEN k % 12 = 2 THEN 'SKIPPED' WHEN k % 12 = 3 AND m = 1 THEN 'SKIPPED'
    WHEN k % 12 = 4 THEN 'TIMEOUT' WHEN k % 12 = 5 AND m = 1 THEN 'FAILURE' WHEN event_type = 'error' THEN 'FAILURE' ELSE 'SUCCESS' END AS result,
  CASE WHEN m = 6 THEN 'DomainAuthUnsupportedPlatform' WHEN k % 12 = 1 THEN 'DomainAuthProbeFailure' WHEN m = 2 THEN 'DomainAuthUnsupportedProfileMode' WHEN k % 12 = 2 THEN 'LinuxKlistMissing' WHEN k % 12 = 3 AND m = 1 THEN 'LinuxKinitMissing'
    WHEN k % 12 = 4 THEN 'DomainAuthTimeout' WHEN k % 12 = 5 AND m = 1 THEN 'LinuxKerberosAcquireFailed' WHEN event_type = 'error' THEN 'LinuxKerberosTicketMissing' END AS error_code,
  CASE WHEN m = 6 THEN 'domainAuth is supported on Linux collectors only.' WHEN k % 12 = 1 THEN 'boom' WHEN m = 2 THEN 'domainAuth requires currentContext or kerberosKeytab Linux auth.'
    WHEN k % 12 = 2 THEN 'klist is required for Linux domainAuth probes.' WHEN k % 12 = 3 AND m = 1 THEN 'kinit is required for keytab-backed Linux domainAuth probes.'
    WHEN k % 12 = 4 THEN 'domainAuth probe exceeded 15 seconds.' WHEN k % 12 = 5 AND m = 1 THEN 'Kerberos ticket acquisition failed for the Linux domainAuth probe.'
    WHEN event_type = 'error' THEN CASE WHEN m = 1 THEN 'Kerberos ticket cache validation failed after keytab acquisition.' ELSE 'Kerberos ticket cache validation failed for the current Linux context.' END
    WHEN m = 1 THEN 'Kerberos ticket acquisition and validation succeeded.' ELSE 'Kerberos ticket cache is available in the current Linux context.' END AS details,
  CASE WHEN m IN (1, 2) THEN '{"linuxProfileId":"p1"}' ELSE '{}' END AS metadata FROM runs"""
    ),
)
def auth_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(
        spark,
        sf_dir,
        "if(m = 6, 'windows', 'linux') AS platform",
        "if(m IN (1, 2), 'p1', '') AS profile_id",
        "CASE WHEN m = 1 THEN 'kerberosKeytab' WHEN m = 2 THEN 'usernamePassword' ELSE 'currentContext' END AS profile_mode",
        "k % 12 <> 2 AS has_klist",
        "k % 12 <> 3 AS has_kinit",
        "if(k % 12 = 5, 1, 0) AS kinit_exit_code",
        "if(event_type = 'error', 1, 0) AS klist_exit_code",
        "k % 12 = 4 AS timed_out",
        "CAST(NULL AS STRING) AS error_code",
        "CASE WHEN k % 12 = 1 THEN 'boom' END AS error_text",
    )
    return _outcomes(probes.auth_events(runs), "metadata")


# -- inventory ---------------------------------------------------------------


@query(
    "join_tag_inventory",
    with_base(
        """, tagged AS (SELECT event_id, k, CASE WHEN g = 7 THEN 'internal' WHEN g % 2 = 0 THEN 'external' ELSE 'internal' END AS kind FROM named)
  SELECT event_id, CASE k % 5 WHEN 0 THEN concat('{"targetKind":"', kind, '"', CASE WHEN kind = 'external' THEN ',"targetClass":"internet"' ELSE '' END, '}')
    WHEN 1 THEN '{"targetKind":"external","targetClass":"internet"}'
    WHEN 2 THEN concat('{"role":"hop","targetKind":"', kind, '"', CASE WHEN kind = 'external' THEN ',"targetClass":"internet"' ELSE '' END, '}')
    WHEN 3 THEN concat('{"targetClass":"x","targetKind":"', kind, '"}') ELSE '{"targetKind":null}' END AS metadata FROM tagged"""
    ),
)
def join_tag_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = named(spark, sf_dir)
    kinds = (
        rows.filter("g <> 7")
        .groupBy("agent_id", "target_id")
        .agg(F.max(F.expr("if(g % 2 = 0, 'external', 'internal')")).alias("target_kind"))
    )
    events = rows.selectExpr(
        "event_id",
        "agent_id",
        "target_id",
        """CASE k % 5 WHEN 0 THEN '{}' WHEN 1 THEN '{"targetKind": "external"}' WHEN 2 THEN '{"role": "hop"}'
           WHEN 3 THEN '{"targetClass": "x"}' ELSE '{"targetKind": null}' END AS metadata""",
    )
    return probes.tag_events(events, kinds).select("event_id", "metadata")


@query(
    "join_auth_profile",
    with_base(
        """, wanted AS (SELECT event_id, a, CASE WHEN k % 3 = 0 THEN 'p1' WHEN k % 5 = 0 THEN 'p2' WHEN k % 5 = 1 THEN 'zz' ELSE '' END AS profile_id FROM named)
  SELECT event_id, profile_id, CASE WHEN profile_id = '' THEN 'currentContext' WHEN profile_id = 'p1' THEN 'kerberosKeytab' WHEN profile_id = 'p2' AND a % 2 = 0 THEN 'usernamePassword' END AS profile_mode,
    CASE WHEN profile_id = 'zz' OR (profile_id = 'p2' AND a % 2 = 1) THEN 'LinuxProfileNotFound' END AS profile_error FROM wanted"""
    ),
)
def join_auth_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = named(spark, sf_dir)
    agents = rows.select("agent_id", "a").distinct()
    profiles = agents.selectExpr("agent_id", "'p1' AS profile_id", "'kerberosKeytab' AS mode", "0 AS position").unionByName(
        agents.filter("a % 2 = 0").selectExpr("agent_id", "'p2' AS profile_id", "'usernamePassword' AS mode", "1 AS position")
    )
    requests = rows.selectExpr(
        "event_id",
        "agent_id",
        "CASE k % 3 WHEN 0 THEN 'p1' WHEN 1 THEN ' ' END AS share_profile_id",
        "CASE k % 5 WHEN 0 THEN 'p2' WHEN 1 THEN 'zz' ELSE '' END AS target_profile_id",
    )
    return inventory.join_auth_profile(requests, profiles).select("event_id", "profile_id", "profile_mode", "profile_error")


# -- extensions --------------------------------------------------------------


def _probe_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One target per event."""
    return named(spark, sf_dir).selectExpr(
        "agent_id",
        "site_id",
        "concat('e-', event_id) AS target_id",
        "concat(target_id, '.example.net') AS fqdn",
        "concat('10.9.', a, '.', g) AS target_address",
        "ts AS captured_utc",
    )


_PROBE_COLUMNS = T.StructType(
    [
        T.StructField("result", T.StringType()),
        T.StructField("details", T.StringType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("hop_index", T.IntegerType()),
        T.StructField("error_code", T.StringType()),
        T.StructField("test_type", T.StringType()),
        T.StructField("metadata", T.StringType()),
    ]
)


@query(
    "ext_probe",
    with_base(
        """, t AS (SELECT event_id, agent_id, site_id, a, g, concat('e-', CAST(event_id AS VARCHAR)) AS target_id, event_id % 4 AS c FROM named)
  SELECT agent_id, site_id, target_id, CASE WHEN n = 1 AND c = 3 THEN 'tls' ELSE 'certificate' END AS test_type, 'check' AS probe_name,
    CASE WHEN c = 0 THEN 'EMPTY' WHEN c = 1 THEN 'FATAL' WHEN c = 2 THEN 'INFO' WHEN n = 1 THEN 'SUCCESS' ELSE 'FAILURE' END AS result,
    CASE WHEN c = 1 THEN 'ExtensionProbeFailure' WHEN n = 2 THEN 'Expired' END AS error_code,
    CASE WHEN c = 0 THEN 'Extension certificate returned no events.' WHEN c = 1 THEN concat('no route to 10.9.', CAST(a AS VARCHAR), '.', CAST(g AS VARCHAR))
         WHEN c = 2 THEN 'Extension completed without additional details.' WHEN n = 1 THEN 'ok' ELSE 'old' END AS details,
    CASE WHEN c = 3 AND n = 1 THEN 1.5 END::DOUBLE AS latency_ms, CAST(NULL AS INT) AS hop_index,
    CASE WHEN c = 3 AND n = 1 THEN '{"extensionId":"own"}' WHEN n = 2 THEN '{"days":3,"extensionId":"certificate"}' ELSE '{"extensionId":"certificate"}' END AS metadata
  FROM t CROSS JOIN (VALUES (1), (2)) AS r(n) WHERE n = 1 OR c = 3"""
    ),
)
def ext_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A local function travels to the workers with the task; they need not import this module.
    def certificate_probe(target: dict) -> list[dict]:
        """Per target: nothing, an error, one default event, or two events of its own."""
        case = int(target["target_id"][2:]) % 4
        if case == 0:
            return []
        if case == 1:
            raise ValueError(f"no route to {target['target_address']}")
        if case == 2:
            return [{"latency_ms": float("nan"), "hop_index": -1, "error_code": "  "}]
        return [
            {"result": "SUCCESS", "details": "ok", "latency_ms": 1.5, "test_type": "tls", "metadata": '{"extensionId":"own"}'},
            {"result": "FAILURE", "details": "old", "error_code": "Expired", "metadata": '{"days":3}'},
        ]

    extension = extensions.register_probe(
        "certificate", extensions.python_probe(certificate_probe, _PROBE_COLUMNS), entry_point="check"
    )
    events = extensions.run_probe(_probe_targets(spark, sf_dir), extension)
    return events.select(
        "agent_id", "site_id", "target_id", "test_type", "probe_name", "result", "error_code", "details", "latency_ms", "hop_index", "metadata"
    )


@query(
    "ext_normalize",
    with_base(
        """SELECT agent_id, concat('e-', CAST(event_id AS VARCHAR)) AS target_id, CASE WHEN k % 2 = 0 THEN 'given.example.net' ELSE concat(target_id, '.example.net') END AS fqdn,
  'latency' AS test_type, 'probe' AS probe_name, 'INFO' AS result, 'Extension completed without additional details.' AS details, value AS latency_ms,
  CASE WHEN k % 5 = 4 THEN '{"a":1,"extensionId":"latency"}' WHEN k % 5 = 0 THEN '{"extensionId":"own"}' ELSE '{"extensionId":"latency"}' END AS metadata FROM named"""
    ),
)
def ext_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probe in DataFrame code that sets three columns only; its metadata is not always a JSON object."""
    returned = named(spark, sf_dir).selectExpr(
        "agent_id",
        "concat('e-', event_id) AS target_id",
        "CASE WHEN k % 2 = 0 THEN 'given.example.net' END AS fqdn",
        "value AS latency_ms",
        """CASE k % 5 WHEN 0 THEN '{"extensionId":"own"}' WHEN 1 THEN '[1]' WHEN 2 THEN '7' WHEN 3 THEN '{"bro' ELSE '{"a":1}' END AS metadata""",
    )
    events = extensions.normalize_events(returned, _probe_targets(spark, sf_dir), "latency")
    return events.select(
        "agent_id", "target_id", "fqdn", "test_type", "probe_name", "result", "details", "latency_ms", "metadata"
    )
