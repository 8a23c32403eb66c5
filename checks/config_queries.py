"""Queries over collector configurations: one document per row of ``customer``.

The documents carry every kind of mistake the rules look for. The SQL states the expected rows
from the customer number ``c`` and the target number ``i``; it never parses a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import query
from linkscope.operators import inventory
from linkscope.session import shared_folder
from linkscope.sinks import files as file_sink
from linkscope.sources import configs

# -- documents ---------------------------------------------------------------

TARGET = """named_struct(
  'id', CASE WHEN i = 2 AND c % 10 = 3 THEN 't0' WHEN i = 1 AND c % 9 = 0 THEN 't0-internet' WHEN i = 0 AND c % 8 = 4 THEN 't2-internet' ELSE concat('t', i) END,
  'fqdn', if((c + i) % 23 = 0, '', concat('t', i, '.c', c, '.example.net')),
  'address', if((c + i) % 29 = 0, CAST(NULL AS STRING), concat('10.0.', i, '.', c % 250)),
  'tests', CASE (c + i) % 4 WHEN 1 THEN array('ping', 'dns') WHEN 2 THEN array('ping', 'TraceRoute') WHEN 3 THEN array('ping', 'ext-a') END,
  'externalTraceTarget', CASE WHEN (c + i) % 4 = 2 THEN '8.8.8.8' WHEN (c + i) % 6 = 1 THEN ' ' WHEN (c + i) % 6 = 3 THEN '8.8.4.4' END,
  'linuxProfileId', CASE (c + i) % 9 WHEN 0 THEN 'p1' WHEN 4 THEN 'nope' END,
  'shares', CASE WHEN (c + i) % 3 = 1 THEN array(
     named_struct('id', 's0', 'path', '//x/s0', 'linuxProfileId', CAST(NULL AS STRING)),
     named_struct('id', if((c + i) % 12 = 4, '', 's1'), 'path', if((c + i) % 24 = 7, ' ', '//x/s1'), 'linuxProfileId', 'p1')) END)"""

DOCUMENT = f"""to_json(named_struct(
  'schemaVersion', CASE c % 50 WHEN 7 THEN '0.9' WHEN 8 THEN CAST(NULL AS STRING) ELSE '1.0' END,
  'agent', named_struct('agentId', if(c % 60 = 11, '  ', concat('agent-', c)), 'siteId', CASE WHEN c % 7 <> 0 THEN concat('site-', n) END,
     'cycleIntervalSeconds', CASE c % 11 WHEN 3 THEN parse_json('"90"') WHEN 4 THEN parse_json('"oops"') WHEN 5 THEN parse_json('45.5') WHEN 6 THEN parse_json('null') END),
  'tests', named_struct('enabled', CASE c % 4 WHEN 0 THEN parse_json('["ping", "traceroute"]') WHEN 1 THEN parse_json('"ping"') END, 'pingTimeoutMs', CASE WHEN c % 3 = 0 THEN 1000 END),
  'auth', named_struct('linuxProfiles', CASE c % 6
     WHEN 0 THEN array(named_struct('id', 'p1', 'mode', 'kerberosKeytab', 'secretReference', 's.json'))
     WHEN 1 THEN array(named_struct('id', 'p1', 'mode', 'currentContext', 'secretReference', 's.json'), named_struct('id', 'p1', 'mode', 'kerberosKeytab', 'secretReference', ' '))
     WHEN 3 THEN array(named_struct('id', 'p1', 'mode', 'usernamePassword', 'secretReference', 's.json'))
     WHEN 4 THEN array(named_struct('id', 'p1', 'mode', 'badMode', 'secretReference', ''), named_struct('id', '', 'mode', '', 'secretReference', '')) END),
  'publish', named_struct('csvMirror', CASE c % 13 WHEN 2 THEN parse_json('"false"') WHEN 3 THEN parse_json('0') WHEN 4 THEN parse_json('true') END, 'azure', named_struct('enabled', c % 14 = 5, 'accountName', if(c % 28 = 5, '', 'account'), 'containerName', if(c % 42 = 5, ' ', 'box'))),
  'targets', CASE WHEN c % 5 > 0 THEN transform(sequence(0, CAST(c % 5 AS INT) - 1), i -> {TARGET}) END,
  'internetTargets', CASE c % 5 WHEN 1 THEN array(named_struct('id', 'net0', 'name', concat('Net ', c), 'address', '1.1.1.1', 'tests', CAST(NULL AS VARIANT)))
     WHEN 2 THEN array(named_struct('id', 't0-internet', 'name', CAST(NULL AS STRING), 'address', '9.9.9.9', 'tests', parse_json('"internetQuality"')), named_struct('id', '', 'name', '', 'address', '', 'tests', parse_json('[]'))) END,
  'extensions', CASE WHEN c % 2 = 0 THEN array(named_struct('id', 'EXT-a', 'path', 'p.ps1', 'enabled', CAST(NULL AS BOOLEAN), 'targets', array('t0', 'T1'), 'inlineScript', CAST(NULL AS STRING)))
     WHEN c % 3 = 0 THEN array(named_struct('id', 'ext-a', 'path', '', 'enabled', false, 'targets', CAST(NULL AS ARRAY<STRING>), 'inlineScript', CAST(NULL AS STRING)),
        named_struct('id', 'ext-a', 'path', 'q.ps1', 'enabled', true, 'targets', CAST(NULL AS ARRAY<STRING>), 'inlineScript', 'x')) END
))"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS c", "c_nationkey AS n")
    return customers.selectExpr("c", "concat('cfg-', c) AS config_id", f"{DOCUMENT} AS document")


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configs.with_defaults(configs.parse_configs(documents(spark, sf_dir)))


# -- the same in SQL ---------------------------------------------------------


def _text(value: str) -> str:
    return f"CAST({value} AS VARCHAR)"


DOCS_SQL = """docs AS (SELECT c_custkey AS c, c_nationkey AS n, concat('cfg-', CAST(c_custkey AS VARCHAR)) AS config_id,
  CASE WHEN c_custkey % 60 = 11 THEN '  ' ELSE concat('agent-', CAST(c_custkey AS VARCHAR)) END AS agent_id,
  CASE WHEN c_custkey % 7 = 0 THEN 'default-site' ELSE concat('site-', CAST(c_nationkey AS VARCHAR)) END AS site_id,
  CASE c_custkey % 4 WHEN 0 THEN ['ping', 'traceroute'] WHEN 1 THEN ['ping'] ELSE ['ping', 'dns', 'share', 'internetQuality', 'traceroute'] END AS enabled
  FROM customer), configured AS (
  SELECT *, CASE WHEN i = 2 AND c % 10 = 3 THEN 't0' WHEN i = 1 AND c % 9 = 0 THEN 't0-internet' WHEN i = 0 AND c % 8 = 4 THEN 't2-internet' ELSE concat('t', CAST(i AS VARCHAR)) END AS target_id,
    CASE WHEN (c + i) % 23 = 0 THEN '' ELSE concat('t', CAST(i AS VARCHAR), '.c', CAST(c AS VARCHAR), '.example.net') END AS fqdn,
    CASE WHEN (c + i) % 29 <> 0 THEN concat('10.0.', CAST(i AS VARCHAR), '.', CAST(c % 250 AS VARCHAR)) END AS target_address,
    CASE (c + i) % 4 WHEN 1 THEN ['ping', 'dns'] WHEN 2 THEN ['ping', 'TraceRoute'] WHEN 3 THEN ['ping', 'ext-a'] ELSE enabled END AS configured_tests,
    CASE (c + i) % 9 WHEN 0 THEN 'p1' WHEN 4 THEN 'nope' ELSE '' END AS linux_profile_id,
    CASE WHEN (c + i) % 4 = 2 THEN '8.8.8.8' WHEN (c + i) % 6 = 1 THEN ' ' WHEN (c + i) % 6 = 3 THEN '8.8.4.4' END AS given_trace
  FROM docs, unnest(range(c % 5)) AS r(i)
), judged AS (
  SELECT *, coalesce(given_trace, target_address) AS trace, list_filter(configured_tests, lambda t: lower(t) IN ('internetquality', 'traceroute')) AS moved,
    list_filter(configured_tests, lambda t: lower(t) NOT IN ('internetquality', 'traceroute')) AS kept FROM configured
), marked AS (
  SELECT *, len(moved) > 0 OR coalesce(trim(given_trace) <> '', false) AS promoted FROM judged
), internal AS (
  SELECT *, CASE WHEN promoted THEN kept ELSE configured_tests END AS tests FROM marked
), promoted AS (
  SELECT config_id, c, agent_id, site_id, i, concat(fqdn, ' Internet') AS fqdn, CASE WHEN trim(coalesce(trace, '')) = '' THEN target_address ELSE trace END AS target_address,
    concat(target_id, '-internet', CASE WHEN EXISTS (SELECT 1 FROM marked o WHERE o.config_id = m.config_id AND o.i <= m.i AND o.target_id = concat(m.target_id, '-internet')) THEN '-2' ELSE '' END) AS target_id,
    CASE WHEN len(moved) > 0 THEN moved ELSE ['internetQuality', 'traceroute'] END AS tests
  FROM marked m WHERE promoted
), internet AS (
  SELECT config_id, c, agent_id, site_id, 0 AS i, CASE WHEN c % 5 = 1 THEN 'net0' ELSE 't0-internet' END AS target_id, CASE WHEN c % 5 = 1 THEN concat('Net ', CAST(c AS VARCHAR)) ELSE '9.9.9.9' END AS fqdn,
    CASE WHEN c % 5 = 1 THEN '1.1.1.1' ELSE '9.9.9.9' END AS target_address, CASE WHEN c % 5 = 1 THEN ['internetQuality', 'traceroute'] ELSE ['internetQuality'] END AS tests
  FROM docs WHERE c % 5 IN (1, 2)
  UNION ALL SELECT config_id, c, agent_id, site_id, 1, '', '', '', [] FROM docs WHERE c % 5 = 2
), every AS (
  SELECT config_id, c, agent_id, site_id, 0 AS list, i, target_id, fqdn, target_address, tests, 'internal' AS target_kind FROM internal
  UNION ALL SELECT config_id, c, agent_id, site_id, 1, i, target_id, fqdn, target_address, tests, 'external' FROM internet
  UNION ALL SELECT config_id, c, agent_id, site_id, 2, i, target_id, fqdn, target_address, tests, 'external' FROM promoted
), shares AS (
  SELECT config_id, c, i, agent_id, target_id, s AS share_position, CASE WHEN s = 0 THEN 's0' WHEN (c + i) % 12 = 4 THEN '' ELSE 's1' END AS share_id,
    CASE WHEN s = 0 THEN '//x/s0' WHEN (c + i) % 24 = 7 THEN ' ' ELSE '//x/s1' END AS share_path, CASE WHEN s = 0 THEN '' ELSE 'p1' END AS linux_profile_id
  FROM internal, unnest(range(2)) AS r(s) WHERE (c + i) % 3 = 1
)"""


def with_docs(sql: str) -> str:
    return f"WITH {DOCS_SQL}\n{sql}"


def _list_sql(column: str) -> str:
    return f"array_to_string({column}, ',') AS {column}"


def _texts(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.array_join(c, ",") for c in columns})


@query(
    "cfg_read",
    with_docs(
        """SELECT agent_id, CASE WHEN c % 7 <> 0 THEN site_id END AS site_id, c % 5 AS target_count, CASE WHEN c % 3 = 0 THEN 1000 END AS ping_timeout_ms FROM docs"""
    ),
)
def cfg_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written one per line, each twice, and read back."""
    folder = shared_folder(spark, "configs")
    texts = documents(spark, sf_dir).select("document")
    file_sink.write_lines(texts.unionByName(texts), folder)
    read = configs.parse_configs(configs.read_configs(spark, folder, "*.jsonl", per_line=True))
    return read.select(
        F.col("config.agent.agentId").alias("agent_id"),
        F.col("config.agent.siteId").alias("site_id"),
        F.coalesce(F.size("config.targets"), F.lit(0)).cast("long").alias("target_count"),
        configs.as_number(F.col("config.tests.pingTimeoutMs")).alias("ping_timeout_ms"),
    )


@query(
    "cfg_defaults",
    with_docs(
        f"""SELECT config_id, CASE c % 50 WHEN 7 THEN '0.9' ELSE '1.0' END AS schema_version, agent_id, site_id, {_list_sql('enabled')}, CASE WHEN c % 3 = 0 THEN 1000 ELSE 3000 END AS ping_timeout_ms,
  4 AS sample_count, 'events' AS blob_prefix, 'currentContext' AS smb_mode, c % 14 = 5 AS azure_enabled,
  CASE c % 11 WHEN 3 THEN 90 WHEN 5 THEN 46 ELSE 30 END AS cycle_seconds, c % 13 IN (2, 4) AS csv_mirror FROM docs"""
    ),
)
def cfg_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).select(
        "config_id",
        F.col("config.schemaVersion").alias("schema_version"),
        F.col("config.agent.agentId").alias("agent_id"),
        F.col("config.agent.siteId").alias("site_id"),
        F.array_join("config.tests.enabled", ",").alias("enabled"),
        F.col("config.tests.pingTimeoutMs").alias("ping_timeout_ms"),
        F.col("config.tests.internetQualitySampleCount").alias("sample_count"),
        F.col("config.publish.azure.blobPrefix").alias("blob_prefix"),
        F.col("config.auth.linuxSmbMode").alias("smb_mode"),
        F.col("config.publish.azure.enabled").alias("azure_enabled"),
        F.col("config.agent.cycleIntervalSeconds").alias("cycle_seconds"),
        F.col("config.publish.csvMirror").alias("csv_mirror"),
    )


@query(
    "cfg_targets",
    with_docs(
        f"""SELECT config_id, agent_id, site_id, CAST(i AS INT) AS position, target_id, fqdn, target_address, {_list_sql('tests')}, '' AS dns_servers, '' AS roles, '' AS tags,
  linux_profile_id, 'internal' AS target_kind, trace AS external_trace_target FROM internal"""
    ),
)
def cfg_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(inventory.targets(parsed(spark, sf_dir)), "tests", "dns_servers", "roles", "tags")


@query(
    "cfg_internet_targets",
    with_docs(
        f"""SELECT config_id, agent_id, site_id, CAST(i AS INT) AS position, target_id, fqdn, target_address, {_list_sql('tests')}, 'internet' AS roles, 'external' AS tags, 'external' AS target_kind,
  target_address AS external_trace_target FROM internet"""
    ),
)
def cfg_internet_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inventory.internet_targets(parsed(spark, sf_dir)).drop("dns_servers", "linux_profile_id")
    return _texts(rows, "tests", "roles", "tags")


@query(
    "cfg_legacy_promote",
    with_docs(
        f"""SELECT config_id, agent_id, CAST(i AS INT) AS position, target_id, fqdn, target_address, {_list_sql('tests')}, 'external,legacy-migrated' AS tags, 'external' AS target_kind FROM promoted"""
    ),
)
def cfg_legacy_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inventory.promoted_targets(parsed(spark, sf_dir)).select(
        "config_id", "agent_id", "position", "target_id", "fqdn", "target_address", "tests", "tags", "target_kind"
    )
    return _texts(rows, "tests", "tags")


@query(
    "union_targets",
    with_docs("SELECT config_id, list, CAST(i AS INT) AS position, target_id, target_kind FROM every"),
)
def union_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.all_targets(parsed(spark, sf_dir)).select(
        "config_id", "list", "position", "target_id", "target_kind"
    )


@query(
    "cfg_shares",
    with_docs(
        """SELECT config_id, agent_id, target_id, CAST(i AS INT) AS position, CAST(share_position AS INT) AS share_position, share_id, share_path, linux_profile_id FROM shares"""
    ),
)
def cfg_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.shares(parsed(spark, sf_dir))


PLAN_SQL = """SELECT config_id, c, agent_id, site_id, target_id, target_kind, test, CASE WHEN test <> 'ext-a' THEN 'built-in' WHEN c % 2 = 1 AND c % 3 <> 0 THEN 'skipped'
    WHEN c % 2 = 0 AND target_id NOT IN ('t0', 't1') THEN 'skipped' ELSE 'extension' END AS handling
  FROM (SELECT config_id, c, agent_id, site_id, target_id, target_kind, unnest(tests) AS test FROM every)"""


@query("cfg_probe_plan", with_docs(f"SELECT * EXCLUDE (c) FROM ({PLAN_SQL})"))
def cfg_probe_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.probe_plan(parsed(spark, sf_dir)).select(
        "config_id", "agent_id", "site_id", "target_id", "target_kind", "test", "handling"
    )


@query(
    "join_extension",
    with_docs(
        f"""SELECT config_id, target_id, test, handling, CASE WHEN handling = 'skipped' THEN CASE WHEN c % 2 = 0 THEN 'ExtensionTargetExcluded' ELSE 'UnsupportedProbe' END END AS error_code,
  CASE WHEN handling = 'skipped' THEN CASE WHEN c % 2 = 0 THEN 'probe' ELSE 'Probe.Unknown' END WHEN handling = 'extension' THEN 'probe' END AS probe_name,
  CASE WHEN handling = 'skipped' THEN CASE WHEN c % 2 = 0 THEN concat('Extension ext-a is not enabled for target ', target_id, '.') ELSE 'Probe ext-a is not implemented.' END END AS details,
  CASE WHEN test = 'ext-a' AND (c % 2 = 0 OR c % 3 = 0) THEN CASE WHEN c % 2 = 0 THEN 'EXT-a' ELSE 'ext-a' END END AS extension_id FROM ({PLAN_SQL})"""
    ),
)
def join_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = configs.stored_configs(spark, parsed(spark, sf_dir))
    tests = inventory.all_targets(stored).select("config_id", "target_id", F.explode("tests").alias("test"))
    return inventory.join_extension(tests, inventory.extensions(stored)).select(
        "config_id", "target_id", "test", "handling", "error_code", "probe_name", "details", "extension_id"
    )


# Rows of (config_id, section, first place, second place, check, rule, message).
RULES_SQL = """named_targets AS (
  SELECT *, target_id <> '' AND row_number() OVER (PARTITION BY config_id, target_id ORDER BY list, i) > 1 AS repeated FROM every
), broken AS (
  SELECT config_id, 0 AS s, 0 AS p, 0 AS q, 0 AS n, 'schemaVersion' AS rule, 'Only schemaVersion 1.0 is supported.' AS message FROM docs WHERE c % 50 = 7
  UNION ALL SELECT config_id, 0, 0, 0, 1, 'agentId', 'agent.agentId is required.' FROM docs WHERE c % 60 = 11
  UNION ALL SELECT config_id, 0, 0, 0, 3, 'noTargets', 'At least one target or internetTarget is required.' FROM docs WHERE c % 5 = 0
  UNION ALL SELECT config_id, 1, 0, 0, 4, 'secretUnsupported', 'Linux auth profile p1 uses currentContext and must not define a secretReference.' FROM docs WHERE c % 6 = 1
  UNION ALL SELECT config_id, 1, 1, 0, 1, 'duplicateProfile', 'Duplicate Linux auth profile id: p1' FROM docs WHERE c % 6 = 1
  UNION ALL SELECT config_id, 1, 1, 0, 5, 'secretRequired', 'Linux auth profile p1 requires a secretReference.' FROM docs WHERE c % 6 = 1
  UNION ALL SELECT config_id, 1, 0, 0, 3, 'profileModeUnsupported', 'Linux auth profile p1 uses an unsupported mode.' FROM docs WHERE c % 6 = 4
  UNION ALL SELECT config_id, 1, 1, 0, 0, 'profileId', 'Each auth.linuxProfiles entry requires an id.' FROM docs WHERE c % 6 = 4
  UNION ALL SELECT config_id, 1, 1, 0, 2, 'profileMode', 'Linux auth profile  requires mode.' FROM docs WHERE c % 6 = 4
  UNION ALL SELECT config_id, 2, i, -1, 1, 'duplicateTarget', concat('Duplicate target id: ', target_id) FROM named_targets WHERE list = 0 AND repeated
  UNION ALL SELECT config_id, 2, i, -1, 2, 'targetFqdn', concat('Target ', target_id, ' requires fqdn.') FROM internal WHERE fqdn = ''
  UNION ALL SELECT config_id, 2, i, -1, 3, 'targetAddress', concat('Target ', target_id, ' requires address.') FROM internal WHERE target_address IS NULL
  UNION ALL SELECT config_id, 2, i, -1, 4, 'targetProfile', concat('Target ', target_id, ' references an unknown linuxProfileId: ', linux_profile_id) FROM internal
    WHERE linux_profile_id = 'nope' OR (linux_profile_id = 'p1' AND c % 6 IN (2, 5))
  UNION ALL SELECT config_id, 2, i, share_position, 0, 'shareId', concat('Each share for target ', target_id, ' requires an id.') FROM shares WHERE share_id = ''
  UNION ALL SELECT config_id, 2, i, share_position, 1, 'sharePath', concat('Share ', share_id, ' for target ', target_id, ' requires path.') FROM shares WHERE share_path = ' '
  UNION ALL SELECT config_id, 2, i, share_position, 2, 'shareProfile', concat('Share ', share_id, ' for target ', target_id, ' references an unknown linuxProfileId: p1') FROM shares WHERE linux_profile_id = 'p1' AND c % 6 IN (2, 5)
  UNION ALL SELECT config_id, 3, list, i, 0, 'internetTargetId', 'Each internetTarget requires an id.' FROM named_targets WHERE list > 0 AND target_id = ''
  UNION ALL SELECT config_id, 3, list, i, 1, 'duplicateInternetTarget', concat('Duplicate target or internetTarget id: ', target_id) FROM named_targets WHERE list > 0 AND repeated
  UNION ALL SELECT config_id, 3, list, i, 2, 'internetTargetAddress', concat('Internet target ', target_id, ' requires address.') FROM named_targets WHERE list > 0 AND coalesce(target_address, '') = ''
  UNION ALL SELECT config_id, 4, 0, 0, 0, 'azureAccount', 'publish.azure.accountName is required when Azure publishing is enabled.' FROM docs WHERE c % 28 = 5
  UNION ALL SELECT config_id, 4, 0, 0, 1, 'azureContainer', 'publish.azure.containerName is required when Azure publishing is enabled.' FROM docs WHERE c % 14 = 5 AND c % 42 = 5
  UNION ALL SELECT config_id, 5, 0, 0, 3, 'extensionPath', 'Extension ext-a requires a path.' FROM docs WHERE c % 2 = 1 AND c % 3 = 0
  UNION ALL SELECT config_id, 5, 1, 0, 0, 'inlineScript', 'Extensions must reference trusted local script files. Inline script content is not supported.' FROM docs WHERE c % 2 = 1 AND c % 3 = 0
  UNION ALL SELECT config_id, 6, 0, 0, 0, 'settingType', 'Setting agent.cycleIntervalSeconds is no whole number: oops' FROM docs WHERE c % 11 = 4
  UNION ALL SELECT config_id, 5, 1, 0, 2, 'duplicateExtension', 'Duplicate extension id: ext-a' FROM docs WHERE c % 2 = 1 AND c % 3 = 0
)"""


@query("cfg_violations", with_docs(f", {RULES_SQL} SELECT config_id, rule, message FROM broken"))
def cfg_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.violations(parsed(spark, sf_dir)).select("config_id", "rule", "message")


@query(
    "cfg_first_violation",
    with_docs(
        f""", {RULES_SQL} SELECT config_id, count(*) AS violation_count, arg_min(message, s * 1000000 + p * 10000 + (q + 1) * 100 + n) AS first_violation FROM broken GROUP BY config_id"""
    ),
)
def cfg_first_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error a collector would stop at, per document."""
    return inventory.first_violations(inventory.violations(parsed(spark, sf_dir)))


MALFORMED = """CASE c % 5 WHEN 0 THEN '{"schemaVersion' WHEN 1 THEN '[1]'
  WHEN 2 THEN concat('{"targets": {"id": "t", "fqdn": "f", "address": "10.0.0.', c % 250, '"}}')
  WHEN 3 THEN '{"auth": {"linuxProfiles": {"id": "p", "mode": "KERBEROSkeytab"}}, "internetTargets": {"id": "n", "address": "1.1.1.1"}}'
  ELSE '{"extensions": {"id": "x"}, "targets": [{"id": "t", "fqdn": "f", "address": "10.0.0.1"}]}' END"""


@query(
    "cfg_malformed",
    """SELECT concat('odd-', CAST(c_custkey AS VARCHAR)) AS config_id, CASE c_custkey % 5 WHEN 3 THEN 'secretRequired' WHEN 4 THEN 'extensionPath' ELSE 'invalidJson' END AS rule,
  CASE c_custkey % 5 WHEN 3 THEN 'Linux auth profile p requires a secretReference.' WHEN 4 THEN 'Extension x requires a path.' ELSE 'The configuration is no JSON object.' END AS message
  FROM customer WHERE c_custkey % 5 <> 2""",
)
def cfg_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are no objects, single objects where lists are expected, modes in any letter case."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS c")
    odd = customers.selectExpr("concat('odd-', c) AS config_id", f"{MALFORMED} AS document")
    read = configs.with_defaults(configs.parse_configs(odd))
    return inventory.violations(read).select("config_id", "rule", "message")
