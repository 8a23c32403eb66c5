"""Table schemas and the fixed values of the event contract."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the wire contract -----------------------------------------
# Each pair is (column name, JSON field name), in wire order.
WIRE_FIELDS = (
    ("timestamp_utc", "timestampUtc"),
    ("agent_id", "agentId"),
    ("site_id", "siteId"),
    ("target_id", "targetId"),
    ("fqdn", "fqdn"),
    ("target_address", "targetAddress"),
    ("test_type", "testType"),
    ("probe_name", "probeName"),
    ("result", "result"),
    ("latency_ms", "latencyMs"),
    ("loss", "loss"),
    ("error_code", "errorCode"),
    ("details", "details"),
    ("dns_server", "dnsServer"),
    ("hop_index", "hopIndex"),
    ("hop_address", "hopAddress"),
    ("hop_name", "hopName"),
    ("hop_latency_ms", "hopLatencyMs"),
    ("path_hash", "pathHash"),
    ("metadata", "metadata"),
)
RESULTS = ("SUCCESS", "FAILURE", "TIMEOUT", "EMPTY", "SKIPPED", "FATAL", "INFO")
BUILT_IN_TESTS = ("ping", "dns", "share", "domainAuth", "internetQuality", "traceroute")
INTERNET_TESTS = ("internetQuality", "traceroute")
PROFILE_MODES = ("currentContext", "kerberosKeytab", "usernamePassword")
IMPORT_MODES = ("disabled", "local", "azure", "hybrid")

INCIDENT_LIMIT = 25
PATH_CHANGE_LIMIT = 25
VISIBLE_CHANGE_LIMIT = 10
TIMELINE_LIMIT = 240
TIMELINE_SAMPLE = 48
DETAIL_EVENT_LIMIT = 80
DETAIL_INCIDENT_LIMIT = 12
DETAIL_PATH_LIMIT = 8
FEED_LIMIT = 20
DEFAULT_WINDOW_MINUTES = 1440
DEFAULT_IMPORT_INTERVAL_SECONDS = 30
# ---------------------------------------------------------------------------

REQUIRED_TEXT = (
    "agent_id",
    "site_id",
    "target_id",
    "fqdn",
    "target_address",
    "test_type",
    "probe_name",
    "result",
)
OPTIONAL_TEXT = ("error_code", "dns_server", "hop_address", "hop_name", "path_hash")
OPTIONAL_NUMBER = ("latency_ms", "loss", "hop_latency_ms")
OPTIONAL_INTEGER = ("hop_index",)

_COLUMN_TYPES = {
    "timestamp_utc": T.TimestampType(),
    **{name: T.DoubleType() for name in OPTIONAL_NUMBER},
    **{name: T.IntegerType() for name in OPTIONAL_INTEGER},
}

EVENT_COLUMNS = tuple(column for column, _ in WIRE_FIELDS)

# ``metadata`` is the JSON text of one object, so that every file format can hold it.
EVENT_SCHEMA = T.StructType(
    [T.StructField(c, _COLUMN_TYPES.get(c, T.StringType())) for c in EVENT_COLUMNS]
)

# Lineage: which batch and line an event came from (also the tie-breakers for
# events with equal timestamps) and which import run committed it.
LINEAGE_COLUMNS = ("batch_id", "seq", "run_id")

STORED_EVENT_SCHEMA = T.StructType(
    EVENT_SCHEMA.fields
    + [
        T.StructField("batch_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("event_date", T.DateType()),
    ]
)

# Packings: one log entry each, the event files it replaced, and the rows it wrote instead.
PACK_LOG_SCHEMA = T.StructType(
    [T.StructField("pack_id", T.StringType()), T.StructField("packed_utc", T.TimestampType())]
)
REPLACED_SCHEMA = T.StructType(
    [
        T.StructField("file_name", T.StringType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("source_pack", T.StringType()),
        T.StructField("pack_id", T.StringType()),
    ]
)
PACKED_EVENT_SCHEMA = T.StructType([*STORED_EVENT_SCHEMA.fields, T.StructField("pack_id", T.StringType())])

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("source_type", T.StringType()),
        T.StructField("source_identifier", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("imported_utc", T.TimestampType()),
        T.StructField("event_count", T.LongType()),
        T.StructField("run_id", T.StringType()),
    ]
)

IMPORT_RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("run_utc", T.TimestampType()),
        T.StructField("discovered", T.LongType()),
        T.StructField("imported", T.LongType()),
        T.StructField("skipped", T.LongType()),
        T.StructField("failed", T.LongType()),
        T.StructField("backlog", T.LongType()),
        T.StructField("last_error", T.StringType()),
        T.StructField("last_source_identifier", T.StringType()),
        T.StructField("last_imported_batch_utc", T.TimestampType()),
    ]
)
