"""Queries over batch files, ledgers, import runs, sinks and streams.

Input files are written by Spark from the given tables into a fresh shared folder.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.board_queries import AGENTS_SQL, BAD, CHANGES_SQL, INCIDENT_COLUMNS, LATE, PATHS_SQL, ROUTED_SQL, SUMMARY_SQL, with_targets
from checks.fixtures import AS_OF, named, tel, with_base, with_tel
from checks.registry import query
from linkscope import schema
from linkscope.functions.events import source_badge
from linkscope.operators import board
from linkscope.plans import importing, snapshot, status
from linkscope.session import shared_folder
from linkscope.sinks import files as file_sink, packing
from linkscope.sources import batches, tables, validate
from linkscope.streaming import importing as stream_import
from linkscope.streaming import state as stream_state

EVENT_LIST = ", ".join(schema.EVENT_COLUMNS)
# hop_latency_ms is compared at six places: value / hop is not a round number.
EVENT_SQL = EVENT_LIST.replace("hop_latency_ms", "round(hop_latency_ms, 6) AS hop_latency_ms")
IMPORTED_AT = datetime(2024, 2, 1)


def _event_columns(events: DataFrame, *lineage: str) -> DataFrame:
    """Event columns of an imported frame in the types of the oracle."""
    return events.select(*lineage, *schema.EVENT_COLUMNS).withColumns(
        {
            "timestamp_utc": F.col("timestamp_utc").cast("timestamp_ntz"),
            "hop_latency_ms": F.round("hop_latency_ms", 6),
        }
    )


# -- event lines with defects ------------------------------------------------
# Case k % 20 of an event decides how its first line deviates:
#  1 truncated, 2 trailing text, 3 unknown result, 4 number as text, 5 fractional hop index,
#  6 integral float hop index, 7 blank agent, 8 number as agent, 9 snake-case names,
# 10 extra field, 11 metadata array, 12 details missing, 13 padded with a byte order mark,
# 14 a JSON array, the rest plain.
DEFECT = "CASE WHEN seq = 0 THEN k % 20 ELSE 0 END"
SNAKE_LINE = "to_json(struct({}), map('ignoreNullFields', 'false'))".format(
    ", ".join(
        "date_format(timestamp_utc, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\") AS timestamp_utc"
        if c == "timestamp_utc"
        else ("parse_json(metadata) AS metadata" if c == "metadata" else c)
        for c in schema.EVENT_COLUMNS
    )
)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, seq, case, line``: one JSON text per ``tel`` row, some of them defective."""
    numbers = named(spark, sf_dir).select("event_id", "k")
    plain = tel(spark, sf_dir).join(numbers, "event_id").withColumn("case", F.expr(DEFECT))
    line = plain.withColumn("line", file_sink.event_json())
    return line.select(
        "event_id",
        "seq",
        "case",
        F.expr(
            f"""CASE case
            WHEN 1 THEN substring(line, 1, length(line) - 1)
            WHEN 2 THEN concat(line, ' x')
            WHEN 3 THEN regexp_replace(line, '"result":"[A-Z]+"', '"result":"BROKEN"')
            WHEN 4 THEN replace(line, '"loss":null', '"loss":" 12.50 "')
            WHEN 5 THEN replace(line, '"hopIndex":null', '"hopIndex":1.5')
            WHEN 6 THEN replace(line, '"hopIndex":null', '"hopIndex":7.0')
            WHEN 7 THEN regexp_replace(line, '"agentId":"[^"]+"', '"agentId":""')
            WHEN 8 THEN regexp_replace(line, '"agentId":"[^"]+"', '"agentId":12')
            WHEN 9 THEN {SNAKE_LINE}
            WHEN 10 THEN concat('{{"extra":[1,{{"a":"]"}}],', substring(line, 2))
            WHEN 11 THEN regexp_replace(line, '"metadata":.*$', '"metadata":[]}}')
            WHEN 12 THEN regexp_replace(line, '"details":"[^"]*",', '')
            WHEN 13 THEN concat('﻿  ', line, ' \\t ')
            WHEN 14 THEN '[1, 2]'
            ELSE line END"""
        ).alias("line"),
    )


def event_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch per event: its one to six lines, CRLF between them and a blank line after each."""
    text = F.expr("listagg(line, '\\r\\n\\r\\n') WITHIN GROUP (ORDER BY seq)")
    return (
        lines(spark, sf_dir)
        .groupBy("event_id")
        .agg(text.alias("content"))
        .select(F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("source_identifier"), "content")
    )


def event_source(spark: SparkSession, sf_dir: str) -> batches.ContentSource:
    """The event batches as a user-defined source."""
    return batches.register_source("events", lambda session: event_batches(session, sf_dir))


LINES_SQL = f"""numbered AS (
  SELECT t.*, {DEFECT} AS c, concat('event-', CAST(event_id AS VARCHAR)) AS source_identifier, CAST(2 * seq + 1 AS BIGINT) AS line_no
  FROM tel t JOIN (SELECT event_id, k FROM named) USING (event_id)
), judged AS (
  SELECT *, CASE c WHEN 1 THEN concat('Invalid JSON on line ', CAST(line_no AS VARCHAR)) WHEN 2 THEN concat('Invalid JSON on line ', CAST(line_no AS VARCHAR))
    ELSE concat('Event validation failed on line ', CAST(line_no AS VARCHAR), ': ', CASE c
      WHEN 3 THEN 'Unsupported result: BROKEN' WHEN 5 THEN 'hopIndex: integer expected' WHEN 7 THEN 'agentId: text is required'
      WHEN 8 THEN 'agentId: text is required' WHEN 11 THEN 'metadata: an object is required' WHEN 12 THEN 'details: text is required'
      WHEN 14 THEN 'timestampUtc: a date-time is required; agentId: text is required; siteId: text is required; targetId: text is required; fqdn: text is required; targetAddress: text is required; testType: text is required; probeName: text is required; result: text is required; details: text is required; metadata: an object is required'
    END) END AS message
  FROM numbered
), typed AS (
  SELECT * REPLACE (CASE WHEN c = 4 AND loss IS NULL THEN 12.5 ELSE loss END AS loss, CASE WHEN c = 6 THEN 7 ELSE hop_index END AS hop_index),
         CASE WHEN c IN (1, 2, 3, 5, 7, 8, 11, 12, 14) THEN message END AS error FROM judged
), clean AS (
  SELECT * FROM typed WHERE event_id NOT IN (SELECT event_id FROM typed WHERE error IS NOT NULL)
)"""


def with_lines(sql: str) -> str:
    return with_tel(f", {LINES_SQL}\n{sql}")


@query(
    "src_parse_lines",
    with_lines("SELECT source_identifier, line_no, c NOT IN (1, 2) AS is_json FROM typed"),
)
def src_parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = validate.parse_lines(batches.split_lines(event_batches(spark, sf_dir)))
    return parsed.select("source_identifier", "line_no", F.col("document").isNotNull().alias("is_json"))


@query(
    "src_validate_event",
    with_lines(
        """SELECT source_identifier, line_no, error, timestamp_utc, agent_id, result, latency_ms, loss, hop_index, hop_address, metadata
  FROM (SELECT * REPLACE (CASE WHEN c IN (1, 2, 14) THEN NULL ELSE timestamp_utc END AS timestamp_utc,
    CASE WHEN c IN (1, 2, 8, 14) THEN NULL WHEN c = 7 THEN '' ELSE agent_id END AS agent_id,
    CASE WHEN c IN (1, 2, 14) THEN NULL WHEN c = 3 THEN 'BROKEN' ELSE result END AS result,
    CASE WHEN c IN (1, 2, 14) THEN NULL ELSE latency_ms END AS latency_ms, CASE WHEN c IN (1, 2, 14) THEN NULL ELSE loss END AS loss,
    CASE WHEN c IN (1, 2, 11, 14) THEN NULL ELSE metadata END AS metadata) FROM typed)"""
    ),
)
def src_validate_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with its typed values or its error."""
    checked = importing.check_lines(batches.split_lines(event_batches(spark, sf_dir)))
    return checked.select(
        "source_identifier",
        "line_no",
        "error",
        F.col("timestamp_utc").cast("timestamp_ntz").alias("timestamp_utc"),
        "agent_id",
        "result",
        "latency_ms",
        "loss",
        "hop_index",
        "hop_address",
        "metadata",
    )


@query(
    "src_batch_atomic",
    with_lines(f"SELECT source_identifier, line_no, {EVENT_SQL} FROM clean"),
)
def src_batch_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the batches in which every line is good."""
    texts = event_batches(spark, sf_dir)
    keys = ("source_identifier",)
    checked = importing.check_lines(batches.split_lines(texts))
    events = validate.accepted_events(checked, validate.gate_batches(checked, texts, keys), keys)
    return _event_columns(events, "source_identifier", "line_no")


@query(
    "src_envelope",
    with_base(
        """SELECT concat('event-', CAST(event_id AS VARCHAR)) AS source_identifier,
  CASE WHEN k % 10 = 0 THEN 0 ELSE 1 + k % 3 END::BIGINT AS event_count,
  CASE WHEN k % 10 = 0 THEN 'Batch did not contain any event lines.'
       WHEN k % 10 = 1 THEN 'Event validation failed on line 1: Unsupported result: BROKEN' END AS error FROM named"""
    ),
)
def src_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies with none to three events each; the verdict per body."""
    event = F.regexp_replace(
        file_sink.event_json(), '"result":"[A-Z]+"', F.when(F.col("k") % 10 == 1, '"result":"BROKEN"').otherwise('"result":"SUCCESS"')
    )
    rows = tel(spark, sf_dir).filter("seq = 0").join(named(spark, sf_dir).select("event_id", "k"), "event_id")
    bodies = rows.select(
        F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("source_identifier"),
        F.concat(
            F.lit('{"events": ['),
            F.when(F.col("k") % 10 == 0, F.lit("")).otherwise(
                F.concat_ws(", ", F.array_repeat(event, (1 + F.col("k") % 3).cast("int")))
            ),
            F.lit("]}"),
        ).alias("body"),
    )
    keys = ("source_identifier",)
    checked = validate.validate_events(validate.envelope_events(bodies))
    return validate.gate_batches(checked, bodies, keys)


# Each site's events as one text; the same hashed whole, and as a tree of blocks of 4,096 lines.
FINGERPRINT_SQL = """WITH lines AS (
  SELECT n_name AS name, sha256(concat('{"supplier":', CAST(s_suppkey AS VARCHAR), ',"é":"', s_name, '"}')) AS hash,
    concat('{"supplier":', CAST(s_suppkey AS VARCHAR), ',"é":"', s_name, '"}') AS line,
    row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) - 1 AS place
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
), repeated AS (
  SELECT name, hash, line, place + r * count(*) OVER (PARTITION BY name, r) AS place FROM lines, unnest(range(CASE WHEN name < 'C' THEN 1500 ELSE 1 END)) AS t(r)
), blocks AS (
  SELECT name, place // 4096 AS block, sha256(string_agg(hash, '' ORDER BY place)) AS hash FROM repeated GROUP BY name, place // 4096
)
SELECT concat(name, '.jsonl') AS source_identifier,
  CASE WHEN name < 'C' THEN (SELECT sha256(string_agg(b.hash, '' ORDER BY b.block)) FROM blocks b WHERE b.name = r.name)
    ELSE sha256(string_agg(concat(line, chr(10)), '' ORDER BY place)) END AS fingerprint
FROM repeated r GROUP BY name"""


@query("src_fingerprint", FINGERPRINT_SQL)
def src_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as an import sees them, with LF, CR or CRLF by nation; those of the first nations are large."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey AS s_nationkey", "n_name AS name")
    ending = F.expr("CASE s_nationkey % 3 WHEN 0 THEN '\\n' WHEN 1 THEN '\\r' ELSE '\\r\\n' END")
    texts = (
        spark.read.parquet(f"{sf_dir}/supplier.parquet")
        .join(nations, "s_nationkey")
        .withColumn("ending", ending)
        .withColumn("line", F.concat(F.expr("""concat('{"supplier":', s_suppkey, ',"é":"', s_name, '"}')"""), "ending"))
        .groupBy("name")
        .agg(F.expr("listagg(line) WITHIN GROUP (ORDER BY s_suppkey)").alias("text"))
        .select("name", F.expr("CASE WHEN name < 'C' THEN repeat(text, 1500) ELSE text END").alias("text"))
        # The writer ends a file itself.
        .withColumn("text", F.regexp_replace("text", r"[\r\n]+$", ""))
    )
    root = shared_folder(spark, "texts")
    texts.repartition("name").write.partitionBy("name").text(root)
    source = batches.FileSource("local", root, pattern="*.txt", whole_bytes=20_000)
    found = source.batches(spark)
    name = F.regexp_extract("source_identifier", "name=([^/]*)/", 1)
    return found.select(F.concat(F.url_decode(name), F.lit(".jsonl")).alias("source_identifier"), "fingerprint")


# -- files -------------------------------------------------------------------


def _written(spark: SparkSession, sf_dir: str, prefix: str = "") -> str:
    """``tel`` as JSON-lines files, one folder per site."""
    root = shared_folder(spark, "batches")
    file_sink.write_jsonl(tel(spark, sf_dir), f"{root}{prefix}", by_site=True)
    return root


def _line_counts(spark: SparkSession, source: batches.FileSource) -> DataFrame:
    """Lines per folder and their highest number's sum over files, which equals the count."""
    per_file = (
        source.lines(spark, source.batches(spark))
        .groupBy("source_type", "source_identifier")
        .agg(F.count(F.lit(1)).alias("lines"), F.max("line_no").alias("last_line"))
    )
    return per_file.groupBy("source_type", F.regexp_extract("source_identifier", "^(.*)/", 1).alias("folder")).agg(
        F.sum("lines").alias("line_count"), F.sum("last_line").alias("last_lines")
    )


def _line_counts_sql(source: str, folder: str) -> str:
    return f"""SELECT '{source}' AS source_type, concat('{folder}site_id=', site_id) AS folder, count(*) AS line_count, count(*) AS last_lines
  FROM tel GROUP BY site_id"""


@query("src_jsonl_dir", with_tel(_line_counts_sql("local", "")))
def src_jsonl_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_counts(spark, batches.local_source(_written(spark, sf_dir)))


@query("src_object_store", with_tel(_line_counts_sql("azure", "events/")))
def src_object_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _written(spark, sf_dir, "/events")
    return _line_counts(spark, batches.object_store_source(root, "events", fingerprint="stat"))


@query(
    "union_sources",
    with_tel("SELECT 'local' AS source_type, count(*) AS line_count FROM tel UNION ALL SELECT 'azure', count(*) FROM tel"),
)
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid mode: the same files seen through a folder and through a store."""
    root = _written(spark, sf_dir, "/events")
    sources = batches.sources_for_mode("hybrid", f"{root}/events", root, "events")
    everything = batches.union_batches(spark, sources)
    found = None
    for source in sources:
        lines_of = source.lines(spark, source.batches(spark))
        found = lines_of if found is None else found.unionByName(lines_of)
    return (
        found.join(everything, list(batches.BATCH_KEYS), "left_semi")
        .groupBy("source_type")
        .agg(F.count(F.lit(1)).alias("line_count"))
    )


@query(
    "sink_jsonl",
    with_tel(
        """SELECT concat(strftime(timestamp_utc, '%Y-%m-%dT%H:%M:%S.%f'), '0Z') AS timestamp_text, agent_id, result, error_code, details,
  hop_index, metadata, latency_ms IS NULL AS null_latency FROM tel"""
    ),
)
def sink_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written by the sink, read back as plain JSON text."""
    text = spark.read.option("recursiveFileLookup", "true").text(_written(spark, sf_dir))

    def field(name: str) -> Column:
        return F.get_json_object("value", f"$.{name}")

    return text.select(
        field("timestampUtc").alias("timestamp_text"),
        field("agentId").alias("agent_id"),
        field("result").alias("result"),
        field("errorCode").alias("error_code"),
        field("details").alias("details"),
        field("hopIndex").cast("int").alias("hop_index"),
        field("metadata").alias("metadata"),
        F.contains("value", F.lit('"latencyMs":null')).alias("null_latency"),
    )


@query(
    "sink_csv_mirror",
    with_tel(
        """SELECT concat(strftime(timestamp_utc, '%Y-%m-%dT%H:%M:%S.%f'), '0Z') AS timestamp_text, agent_id, site_id, target_id, fqdn, target_address,
  test_type, probe_name, result, latency_ms, loss, coalesce(error_code, '') AS error_code, concat('say "', details, '", ok') AS details FROM tel"""
    ),
)
def sink_csv_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_folder(spark, "mirror")
    quoted = F.concat(F.lit('say "'), F.col("details"), F.lit('", ok'))
    file_sink.write_csv_mirror(tel(spark, sf_dir).withColumn("details", quoted), root)
    read = spark.read.options(header="true", escape='"').csv(root)
    names = dict((wire, column) for column, wire in file_sink.CSV_COLUMNS)
    read = read.withColumnsRenamed({**names, "timestampUtc": "timestamp_text"})
    return read.withColumns(
        {
            "latency_ms": F.col("latency_ms").try_cast("double"),
            "loss": F.col("loss").try_cast("double"),
            "error_code": F.coalesce("error_code", F.lit("")),
        }
    )


@query("sink_site_layout", with_tel("SELECT site_id, agent_id, count(*) AS line_count FROM tel GROUP BY ALL"))
def sink_site_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = spark.read.text(_written(spark, sf_dir))
    return text.groupBy("site_id", F.get_json_object("value", "$.agentId").alias("agent_id")).agg(
        F.count(F.lit(1)).alias("line_count")
    )


# -- ledger and runs ---------------------------------------------------------

LEDGER_SQL = """SELECT concat('b-', CAST(event_id AS VARCHAR)) AS source_identifier,
  CASE WHEN g % 3 = 0 THEN 'azure' WHEN g % 3 = 1 THEN 'local' ELSE 'custom' END AS source_type, k, ts FROM named"""


def _ledger_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch per event, named like a file, with a content-dependent fingerprint."""
    return named(spark, sf_dir).selectExpr(
        "CASE WHEN g % 3 = 0 THEN 'azure' WHEN g % 3 = 1 THEN 'local' ELSE 'custom' END AS source_type",
        "concat('b-', event_id) AS source_identifier",
        "sha2(concat('content ', event_id), 256) AS fingerprint",
        "k",
        "ts",
    )


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches below k = 50 were imported, those from 40 on with another content."""
    known = _ledger_batches(spark, sf_dir).filter("k < 50")
    return known.withColumns(
        {
            "fingerprint": F.expr("if(k >= 40, 'older', fingerprint)"),
            "imported_utc": F.col("ts"),
        }
    )


@query("src_ledger_skip", with_base(f"SELECT source_type, source_identifier FROM ({LEDGER_SQL}) WHERE k >= 40"))
def src_ledger_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = tables.new_batches(_ledger_batches(spark, sf_dir), _ledger(spark, sf_dir))
    return new.select("source_type", "source_identifier")


@query(
    "join_ledger_anti",
    with_base(f"SELECT source_type, count(*) AS new_batches FROM ({LEDGER_SQL}) WHERE k >= 40 GROUP BY source_type"),
)
def join_ledger_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = tables.new_batches(_ledger_batches(spark, sf_dir), _ledger(spark, sf_dir))
    return new.groupBy("source_type").agg(F.count(F.lit(1)).alias("new_batches"))


@query(
    "ledger_last_import",
    with_base(f"SELECT source_type, max(ts) AS last_imported_utc FROM ({LEDGER_SQL}) WHERE k < 50 GROUP BY source_type"),
)
def ledger_last_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.last_import(_ledger(spark, sf_dir))


# An import log with one run per event.
RUNS_SQL = """runs AS (SELECT concat('run-', lpad(CAST(event_id AS VARCHAR), 12, '0')) AS run_id,
  CASE WHEN g % 3 = 0 THEN 'azure' WHEN g % 3 = 1 THEN 'local' ELSE 'custom' END AS source_type, ts AS run_utc,
  CAST(k + 10 AS BIGINT) AS discovered, CAST(k AS BIGINT) AS imported, CAST(CASE WHEN event_type = 'error' THEN 3 ELSE 10 END AS BIGINT) AS skipped,
  CAST(CASE WHEN event_type = 'error' THEN 7 ELSE 0 END AS BIGINT) AS failed, CASE WHEN event_type = 'error' THEN concat('Invalid JSON on line ', CAST(k AS VARCHAR)) END AS last_error,
  concat('b-', CAST(event_id AS VARCHAR)) AS last_source_identifier, CASE WHEN k > 0 THEN ts END AS last_imported_batch_utc FROM named)"""
STATUS_SQL = (
    RUNS_SQL
    + """, status AS (SELECT source_type, max(run_utc) AS last_run_utc, max(CASE WHEN failed = 0 THEN run_utc END) AS last_success_utc,
  (SELECT last_error FROM runs i WHERE i.source_type = o.source_type ORDER BY run_utc DESC, run_id DESC LIMIT 1) AS last_error,
  max(last_imported_batch_utc) AS last_imported_batch_utc, arg_max(last_source_identifier, run_utc) AS last_source_identifier,
  arg_max(discovered, run_utc) AS last_run_discovered, arg_max(imported, run_utc) AS last_run_imported, arg_max(skipped, run_utc) AS last_run_skipped,
  arg_max(failed, run_utc) AS last_run_failed, arg_max(failed, run_utc) AS last_run_backlog, CAST(sum(discovered) AS BIGINT) AS cumulative_discovered,
  CAST(sum(imported) AS BIGINT) AS cumulative_imported, CAST(sum(skipped) AS BIGINT) AS cumulative_skipped, CAST(sum(failed) AS BIGINT) AS cumulative_failed
  FROM runs o GROUP BY source_type)"""
)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(spark, sf_dir).selectExpr(
        "concat('run-', lpad(event_id, 12, '0')) AS run_id",
        "CASE WHEN g % 3 = 0 THEN 'azure' WHEN g % 3 = 1 THEN 'local' ELSE 'custom' END AS source_type",
        "ts AS run_utc",
        "CAST(k + 10 AS BIGINT) AS discovered",
        "CAST(k AS BIGINT) AS imported",
        "if(event_type = 'error', 3L, 10L) AS skipped",
        "if(event_type = 'error', 7L, 0L) AS failed",
        "if(event_type = 'error', 7L, 0L) AS backlog",
        "CASE WHEN event_type = 'error' THEN concat('Invalid JSON on line ', k) END AS last_error",
        "concat('b-', event_id) AS last_source_identifier",
        "CASE WHEN k > 0 THEN ts END AS last_imported_batch_utc",
    )


@query("import_source_status", with_base(f", {STATUS_SQL} SELECT * FROM status"))
def import_source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.import_source_status(_runs(spark, sf_dir))


@query(
    "import_status",
    with_base(
        f""", {STATUS_SQL} SELECT 'hybrid' AS mode, max(last_run_utc) AS last_run_utc, max(last_success_utc) AS last_success_utc,
  (SELECT last_error FROM status WHERE last_error IS NOT NULL ORDER BY last_run_utc DESC, source_type LIMIT 1) AS last_error,
  CAST(sum(cumulative_discovered) AS BIGINT) AS cumulative_discovered, CAST(sum(cumulative_imported) AS BIGINT) AS cumulative_imported,
  CAST(sum(cumulative_skipped) AS BIGINT) AS cumulative_skipped, CAST(sum(cumulative_failed) AS BIGINT) AS cumulative_failed FROM status"""
    ),
)
def import_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.import_status(status.import_source_status(_runs(spark, sf_dir)), "hybrid")


@query(
    "import_run_result",
    with_base(
        f""", {STATUS_SQL} SELECT 'hybrid' AS mode, CAST(sum(last_run_discovered) AS BIGINT) AS discovered, CAST(sum(last_run_imported) AS BIGINT) AS imported,
  CAST(sum(last_run_skipped) AS BIGINT) AS skipped, CAST(sum(last_run_failed) AS BIGINT) AS failed FROM status"""
    ),
)
def import_run_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.import_run_result(status.import_source_status(_runs(spark, sf_dir)), "hybrid")


@query(
    "prj_source_badge",
    with_base(
        f", {STATUS_SQL} SELECT source_type, CASE WHEN last_error IS NULL THEN 'SUCCESS' ELSE 'FAILURE' END AS badge FROM status"
    ),
)
def prj_source_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = status.import_source_status(_runs(spark, sf_dir))
    return rows.select("source_type", source_badge("last_error").alias("badge"))


# -- whole imports -----------------------------------------------------------


@query("sink_append_events", with_tel(f"SELECT {EVENT_SQL} FROM tel"))
def sink_append_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written, imported and read back are ``tel`` again; a second import adds nothing."""
    lake = tables.Lake(shared_folder(spark, "lake"))
    source = batches.local_source(_written(spark, sf_dir))
    for _ in range(2):
        importing.import_source(spark, lake, source, IMPORTED_AT)
    return _event_columns(lake.events(spark))


@query("sink_pack_events", with_tel(f"SELECT {EVENT_SQL} FROM tel"))
def sink_pack_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs write files for the same days; packed, and the small files deleted, they are ``tel`` still."""
    lake = tables.Lake(shared_folder(spark, "lake"))
    part = F.pmod(F.xxhash64("agent_id", "target_id", "timestamp_utc"), F.lit(2))
    for n in range(2):
        root = shared_folder(spark, "batches")
        file_sink.write_jsonl(tel(spark, sf_dir).where(part == n), root, by_site=True)
        importing.import_source(spark, lake, batches.local_source(root), IMPORTED_AT)
    packing.pack_events(spark, lake, least_files=2)
    packing.remove_packed(spark, lake, importing.utc_now() + timedelta(days=1))
    return _event_columns(lake.events(spark))


@query(
    "sink_import_run",
    with_lines(
        """SELECT 'events' AS source_type, run, count(*) AS discovered, CAST(sum(CASE WHEN run = 1 AND NOT bad THEN 1 ELSE 0 END) AS BIGINT) AS imported,
  CAST(sum(CASE WHEN run = 2 AND NOT bad THEN 1 ELSE 0 END) AS BIGINT) AS skipped, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS failed,
  CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS backlog, arg_max(message, source_identifier) FILTER (WHERE bad) AS last_error, max(source_identifier) AS last_source_identifier
  FROM (SELECT source_identifier, bool_or(error IS NOT NULL) AS bad, arg_min(error, line_no) AS message FROM typed GROUP BY source_identifier)
  CROSS JOIN (VALUES (1), (2)) AS r(run) GROUP BY run"""
    ),
)
def sink_import_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the same batches: the second skips the good and fails the bad again."""
    lake = tables.Lake(shared_folder(spark, "lake"))
    source = event_source(spark, sf_dir)
    for hour in (1, 2):
        importing.import_source(spark, lake, source, datetime(2024, 2, 1, hour))
    return lake.import_runs(spark).select(
        "source_type",
        F.hour("run_utc").alias("run"),
        *("discovered", "imported", "skipped", "failed", "backlog", "last_error", "last_source_identifier"),
    )


@query("ext_source", with_lines(f"SELECT {EVENT_SQL} FROM clean"))
def ext_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered source of per-event batches, imported."""
    lake = tables.Lake(shared_folder(spark, "lake"))
    event_source(spark, sf_dir)
    importing.import_source(spark, lake, batches.registered_source("events"), IMPORTED_AT)
    return _event_columns(lake.events(spark))


@query(
    "sink_snapshot",
    with_targets(
        f""", {ROUTED_SQL}, {PATHS_SQL}, {CHANGES_SQL}, {RUNS_SQL}, week AS ({SUMMARY_SQL} WHERE ts >= TIMESTAMP '2024-01-24 00:00:00')
  SELECT 'summary' AS frame, 'all' AS item, concat_ws('|', total_events, total_agents, total_targets, active_sites, failure_events, timeout_events) AS content,
    latest_timestamp_utc AS newest FROM week
  UNION ALL SELECT 'agents', agent_id, concat_ws('|', site_id, total_targets, healthy_targets, failing_targets, timeout_targets), last_timestamp_utc FROM ({AGENTS_SQL})
  UNION ALL SELECT 'sites', concat('site-', a % 5), concat_ws('|', count(DISTINCT a), count(*), count_if({BAD} OR {LATE})), max(ts) FROM newest GROUP BY a % 5
  UNION ALL SELECT 'targets', target_key, concat_ws('|', target_kind, site_id, last_test_type, latest_result), last_timestamp_utc FROM targets
  UNION ALL SELECT 'paths', target_key, concat_ws('|', path_hash, path_preview, hop_count), last_seen_utc FROM paths
  UNION ALL SELECT * FROM (SELECT 'path_changes', target_key, concat_ws('|', previous_path_hash, path_hash, path_preview), timestamp_utc FROM changes
    ORDER BY timestamp_utc DESC, target_key, path_hash LIMIT 25)
  UNION ALL SELECT * FROM (SELECT 'incidents', concat(agent_id, '::', target_id), concat_ws('|', test_type, outcome, concat('event ', event_id)), ts FROM named
    WHERE outcome <> 'SUCCESS' ORDER BY ts DESC, event_id DESC LIMIT 25)
  UNION ALL SELECT 'import_sources', source_type, concat_ws('|', sum(discovered), sum(imported), sum(skipped), sum(failed)), max(run_utc) FROM runs GROUP BY source_type
  UNION ALL SELECT 'import_status', 'hybrid', concat_ws('|', sum(discovered), sum(imported), sum(skipped), sum(failed)), max(run_utc) FROM runs"""
    ),
)
def sink_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all snapshot tables, written and read back."""
    frames = snapshot.board_snapshot(
        spark, tel(spark, sf_dir), _runs(spark, sf_dir), AS_OF, 7 * 1440, "hybrid"
    )
    folder = shared_folder(spark, "board")
    snapshot.write_snapshot(frames, folder)
    stored = snapshot.read_snapshot(spark, folder)
    totals = ("cumulative_discovered", "cumulative_imported", "cumulative_skipped", "cumulative_failed")
    counted = ("total_events", "total_agents", "total_targets", "active_sites", "failure_events", "timeout_events")
    shown = {
        "summary": (F.lit("all"), counted, "latest_timestamp_utc"),
        "agents": (
            "agent_id",
            ("site_id", "total_targets", "healthy_targets", "failing_targets", "timeout_targets"),
            "last_timestamp_utc",
        ),
        "sites": ("site_id", ("agent_count", "target_count", "failing_targets"), "last_timestamp_utc"),
        "targets": ("target_key", ("target_kind", "site_id", "last_test_type", "latest_result"), "last_timestamp_utc"),
        "paths": ("target_key", ("path_hash", "path_preview", "hop_count"), "last_seen_utc"),
        "path_changes": ("target_key", ("previous_path_hash", "path_hash", "path_preview"), "timestamp_utc"),
        "incidents": ("target_key", ("test_type", "result", "details"), "timestamp_utc"),
        "import_sources": ("source_type", totals, "last_run_utc"),
        "import_status": ("mode", totals, "last_run_utc"),
    }
    stacked = None
    for name, (item, content, newest) in shown.items():
        part = stored[name].select(
            F.lit(name).alias("frame"),
            (F.col(item) if isinstance(item, str) else item).alias("item"),
            F.concat_ws("|", *[F.col(column).cast("string") for column in content]).alias("content"),
            F.col(newest).alias("newest"),
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


def read_file(path: str, start: int, count: int) -> bytes:
    """Bytes of a file of the shared folder; called in tasks."""
    with open(path, "rb") as file:
        file.seek(start)
        return file.read(count)


@query("ext_source_ranges", with_tel(f"SELECT {EVENT_SQL} FROM tel"))
def ext_source_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered source whose batches are read in ranges of 20,000 bytes, imported."""
    root = _written(spark, sf_dir)

    def load(session: SparkSession) -> DataFrame:
        found = session.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        return found.select(F.regexp_replace("path", "^file:/*", "/").alias("source_identifier"), "length")

    lake = tables.Lake(shared_folder(spark, "lake"))
    source = batches.register_source("ranges", load, read_file, range_bytes=20_000)
    importing.import_source(spark, lake, source, IMPORTED_AT)
    return _event_columns(lake.events(spark))


# -- streams -----------------------------------------------------------------


def _tel_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tel`` as a stream over its written files."""
    root = shared_folder(spark, "tel")
    tel(spark, sf_dir).write.parquet(root)
    columns = spark.read.parquet(root).schema
    return spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(root)


@query("stream_import", with_tel(f"SELECT {EVENT_SQL} FROM tel"))
def run_stream_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = tables.Lake(shared_folder(spark, "lake"))
    source = batches.local_source(_written(spark, sf_dir))
    stream_import.start_file_import(
        spark, lake, source, shared_folder(spark, "checkpoint"), max_files_per_batch=8
    ).awaitTermination()
    return _event_columns(lake.events(spark))


@query("stream_import_cycles", with_tel(f"SELECT {EVENT_SQL} FROM tel"))
def run_stream_import_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = tables.Lake(shared_folder(spark, "lake"))
    source = batches.local_source(_written(spark, sf_dir))
    checkpoint = shared_folder(spark, "checkpoint")
    stream_import.start_import_cycles(spark, lake, [source], checkpoint, interval_seconds=3600).stop()
    return _event_columns(lake.events(spark))


@query("stream_latest_state", with_targets("SELECT * FROM targets"))
def run_stream_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, folder = _tel_stream(spark, sf_dir), shared_folder(spark, "state")
    stream_state.start_latest_state(events, folder, shared_folder(spark, "checkpoint")).awaitTermination()
    return board.targets_from_state(stream_state.read_latest_state(spark, folder, events))


@query(
    "stream_incidents",
    with_tel(f"SELECT {INCIDENT_COLUMNS}, event_id, seq FROM tel WHERE result NOT IN ('SUCCESS', 'INFO')"),
)
def run_stream_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "incidents")
    stream_state.start_incidents(
        _tel_stream(spark, sf_dir), folder, shared_folder(spark, "checkpoint")
    ).awaitTermination()
    return spark.read.parquet(folder)


@query("stream_path_changes", with_tel(f", {ROUTED_SQL}, {CHANGES_SQL} SELECT * FROM changes"))
def run_stream_path_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "changes")
    stream_state.start_path_changes(
        _tel_stream(spark, sf_dir), folder, shared_folder(spark, "checkpoint")
    ).awaitTermination()
    return stream_state.read_path_changes(spark, folder)
