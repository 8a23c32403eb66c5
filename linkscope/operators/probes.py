"""From captured probe output to events.

The input is a table of runs and a table of their output lines:

* runs: ``run_id, agent_id, site_id, target_id, fqdn, target_address, captured_utc`` plus the
  outcome columns each function names (``exit_code``, ``timed_out``, ``error_text``, ...)
* lines: ``run_id, line_no, line``

Lines are reduced per run before they meet the runs, and every text that is joined from
lines is that of one command's output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkscope import schema
from linkscope.functions.events import blank_to_null, is_object, with_json_fields

# Fixed patterns of the tools' outputs. Letter case does not matter in any of them.
HOP_LINE = r"^\d+\s+.+"
HOP_INDEX = r"^(\d+)\s"
IPV4 = r"(\d{1,3}(\.\d{1,3}){3})"
HOP_LATENCY = r"(?i)(<\d+|\d+(\.\d+)?)\s*ms"
HOP_NAME = r"(?i)^\d+\s+([a-z0-9.\-]+)\s+\(?(\d{1,3}(\.\d{1,3}){3})?\)?"
PLAIN_NUMBER = r"^\d+(\.\d+)?$"
PING_LATENCY = r"(?i)time[=<]([0-9.]+)\s*ms"
DIG_ADDRESS = r"(?i)^(\d{1,3}(\.\d{1,3}){3}|[0-9a-f:]+)$"
NSLOOKUP_ADDRESS = r"(?i)Address:\s+(\d{1,3}(\.\d{1,3}){3})"

# Fixed default time limits in seconds.
SHARE_TIMEOUT = 15
TRACEROUTE_TIMEOUT = 20

# Details that a collector writes into events; stored events hold these texts.
AUTH_CACHE_DONE = "Kerberos ticket cache is available in the current Linux context."
AUTH_CACHE_INVALID = "Kerberos ticket cache validation failed for the current Linux context."
AUTH_KEYTAB_DONE = "Kerberos ticket acquisition and validation succeeded."
AUTH_KEYTAB_INVALID = "Kerberos ticket cache validation failed after keytab acquisition."
AUTH_LATE = "domainAuth probe exceeded {} seconds."
AUTH_MODE = "domainAuth requires currentContext or kerberosKeytab Linux auth."
AUTH_NO_KINIT = "kinit is required for keytab-backed Linux domainAuth probes."
AUTH_NO_KLIST = "klist is required for Linux domainAuth probes."
AUTH_NO_TICKET = "Kerberos ticket acquisition failed for the Linux domainAuth probe."
AUTH_PLATFORM = "domainAuth is supported on Linux collectors only."
DNS_NONE = "DNS query returned no address."
DNS_NULL = "Cannot index into a null array."
DNS_RESOLVED = "Resolved to "
QUALITY_ACROSS = " ms across "
QUALITY_GOOD = " successful samples."
QUALITY_MEAN = "Average latency "
QUALITY_NONE = "Every sample failed."
SHARE_DONE = "Share access confirmed."
SHARE_EMPTY = "Share probe succeeded but returned no visible items."
SHARE_EXIT = "smbclient returned exit code "
SHARE_LATE = "Share probe exceeded {} seconds."
SHARE_MODE = "Linux share probe profile mode is not supported."
SHARE_NONE = "Target has no configured shares."
SHARE_NO_CLIENT = "smbclient is required for Linux share probes."
SHARE_NO_KINIT = "kinit is required for keytab-backed Linux share probes."
SHARE_NO_TICKET = "Kerberos ticket acquisition failed for the Linux share probe."
TRACE_DONE = "Traceroute completed with "
TRACE_HOPS = " hops."
TRACE_LATE = "Traceroute exceeded {} seconds."
TRACE_MISSING = "traceroute command is not available on this host."
TRACE_NO_DATA = "Traceroute completed but no hop data was parsed."

RUN_COLUMNS = ("run_id", "agent_id", "site_id", "target_id", "fqdn", "target_address", "captured_utc")


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r\f\x0b\u00a0"))


def _outcome(result: str, code: str | Column | None, details: str | Column) -> Column:
    code = F.lit(code) if isinstance(code, str) or code is None else code
    details = F.lit(details) if isinstance(details, str) else details
    return F.struct(
        F.lit(result).alias("result"),
        code.cast("string").alias("error_code"),
        details.alias("details"),
    )


def _joined(line: str = "line") -> Column:
    return F.expr(f"listagg({line}, '\n') WITHIN GROUP (ORDER BY line_no)")


def to_events(rows: DataFrame, test_type: str, probe_name: str) -> DataFrame:
    """Fill the event columns a probe did not set, blank texts as null."""
    present = set(rows.columns)
    defaults = {
        "timestamp_utc": F.col("captured_utc"),
        "test_type": F.lit(test_type),
        "probe_name": F.lit(probe_name),
        "metadata": F.lit("{}"),
    }
    columns = []
    for field in schema.EVENT_SCHEMA:
        if field.name in present:
            value = F.col(field.name)
            if field.name in schema.OPTIONAL_TEXT:
                value = blank_to_null(value)
        else:
            value = defaults.get(field.name, F.lit(None).cast(field.dataType))
        columns.append(value.alias(field.name))
    return rows.select(*columns, "run_id")


# -- traceroute --------------------------------------------------------------


def trace_hops(lines: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Hop columns of every line that starts with a hop number; other lines are dropped."""
    line = F.col("line")
    address = F.regexp_extract(line, IPV4, 1)
    name = F.regexp_extract(line, HOP_NAME, 1)
    latency = F.ltrim(F.regexp_extract(line, HOP_LATENCY, 1), F.lit("<"))
    is_name = (F.length(name) > 0) & (name != address) & ~F.regexp_like(name, F.lit(PLAIN_NUMBER))
    return (
        lines.select(*keys, "line_no", _strip(line).alias("line"))
        .filter(F.regexp_like("line", F.lit(HOP_LINE)))
        .select(
            *keys,
            "line_no",
            F.regexp_extract("line", HOP_INDEX, 1).cast("int").alias("hop_index"),
            blank_to_null(address).alias("hop_address"),
            F.when(is_name, name).alias("hop_name"),
            latency.try_cast("double").alias("hop_latency_ms"),
            F.col("line").alias("details"),
        )
    )


def trace_path_hashes(hops: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Path hash and hop count per run: a digest of ``index:address`` in line order."""
    step = F.concat(F.col("hop_index").cast("string"), F.lit(":"), F.coalesce("hop_address", F.lit("")))
    route = F.expr("listagg(step, '|') WITHIN GROUP (ORDER BY line_no)")
    return (
        hops.withColumn("step", step)
        .groupBy(*keys)
        .agg(route.alias("route"), F.count(F.lit(1)).alias("hop_count"))
        .select(*keys, F.substring(F.sha2("route", 256), 1, 16).alias("path_hash"), "hop_count")
    )


def trace_summary(hashes: DataFrame) -> DataFrame:
    """The SUCCESS row of each trace with hops, whether or not the destination was reached."""
    return hashes.select(
        "*",
        F.lit("SUCCESS").alias("result"),
        F.concat(F.lit(TRACE_DONE), F.col("hop_count"), F.lit(TRACE_HOPS)).alias("details"),
        F.to_json(F.struct(F.lit("summary").alias("role"), F.col("hop_count").alias("hopCount"))).alias(
            "metadata"
        ),
    )


def trace_outcome(runs: DataFrame, hashes: DataFrame, timeout_seconds: int = TRACEROUTE_TIMEOUT) -> DataFrame:
    """One outcome per run.

    Outcome columns of ``runs``: ``tool_missing``, ``timed_out`` and ``error_text``.
    """
    outcome = (
        F.when(
            F.col("tool_missing"),
            _outcome("SKIPPED", "TracerouteMissing", TRACE_MISSING),
        )
        .when(F.col("error_text").isNotNull(), _outcome("FATAL", "TracerouteFailure", F.col("error_text")))
        .when(
            F.col("timed_out"),
            _outcome("TIMEOUT", "TracerouteTimeout", TRACE_LATE.format(timeout_seconds)),
        )
        .when(
            F.col("hop_count").isNull(),
            _outcome("FAILURE", "NoPathData", TRACE_NO_DATA),
        )
        .otherwise(
            _outcome(
                "SUCCESS",
                None,
                F.concat(F.lit(TRACE_DONE), F.col("hop_count"), F.lit(TRACE_HOPS)),
            )
        )
    )
    return (
        runs.join(hashes, "run_id", "left")
        .withColumn("outcome", outcome)
        .select(*RUN_COLUMNS, *[c for c in hashes.columns if c != "run_id"], "outcome.*")
    )


def _hop_sets(hops: DataFrame) -> DataFrame:
    """All hops of a run as one array in line order, with its path hash.

    A run is the output of one command, so its array is short.
    """
    fields = ("line_no", "hop_index", "hop_address", "hop_name", "hop_latency_ms", "details")
    steps = F.transform(
        "hops",
        lambda h: F.concat(h["hop_index"].cast("string"), F.lit(":"), F.coalesce(h["hop_address"], F.lit(""))),
    )
    return (
        hops.groupBy("run_id")
        .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("hops"))
        .select(
            "run_id",
            "hops",
            F.size("hops").cast("long").alias("hop_count"),
            F.substring(F.sha2(F.array_join(steps, "|"), 256), 1, 16).alias("path_hash"),
        )
    )


def trace_events(runs: DataFrame, lines: DataFrame, timeout_seconds: int = TRACEROUTE_TIMEOUT) -> DataFrame:
    """Hop events and a summary per good run, one failure event per other run.

    Lines are parsed once and shuffled once, by run.
    """
    sets = _hop_sets(trace_hops(lines))
    good = F.col("result") == "SUCCESS"

    def event(probe_name, result, code, details, metadata, hop=None) -> Column:
        return F.struct(
            probe_name.alias("probe_name"),
            result.alias("result"),
            code.alias("error_code"),
            details.alias("details"),
            metadata.alias("metadata"),
            *[
                (hop[name] if hop is not None else F.lit(None).cast(kind)).alias(name)
                for name, kind in (
                    ("hop_index", "int"),
                    ("hop_address", "string"),
                    ("hop_name", "string"),
                    ("hop_latency_ms", "double"),
                )
            ],
        )

    summary_metadata = F.to_json(
        F.struct(F.lit("summary").alias("role"), F.col("hop_count").alias("hopCount"))
    )
    summary = event(
        F.when(good, "Traceroute.Summary").otherwise("Traceroute.Path"),
        F.col("result"),
        F.col("error_code"),
        F.col("details"),
        F.when(good, summary_metadata).otherwise("{}"),
    )
    hop_events = F.transform(
        "hops",
        lambda hop: event(
            F.lit("Traceroute.Path"),
            F.lit("INFO"),
            F.lit(None).cast("string"),
            hop["details"],
            F.lit('{"role":"hop"}'),
            hop,
        ),
    )
    outcomes = trace_outcome(runs, sets, timeout_seconds)
    rows = outcomes.select(
        *RUN_COLUMNS,
        F.when(good, F.col("path_hash")).alias("path_hash"),
        # Never empty; the outer form spares a filter that would build the array twice.
        F.explode_outer(
            F.when(good, F.concat(F.array(summary), hop_events)).otherwise(F.array(summary))
        ).alias("event"),
    )
    return to_events(rows.select(*RUN_COLUMNS, "path_hash", "event.*"), "traceroute", "Traceroute.Path")


# -- ping --------------------------------------------------------------------


def ping_events(runs: DataFrame, lines: DataFrame) -> DataFrame:
    """Outcome of a native ping: exit code 0 is a success with the first latency printed.

    Outcome columns of ``runs``: ``exit_code`` and ``error_text``.
    """
    latency = F.regexp_extract("line", PING_LATENCY, 1)
    output = lines.groupBy("run_id").agg(
        F.min_by(latency, F.when(F.length(latency) > 0, F.col("line_no"))).alias("latency"),
        F.max_by("line", "line_no").alias("last_line"),
        _joined().alias("output"),
    )
    failed = F.col("error_text").isNotNull()
    good = ~failed & (F.col("exit_code") == 0)
    outcome = (
        F.when(failed, _outcome("FATAL", "NativePingException", F.col("error_text")))
        .when(good, _outcome("SUCCESS", None, F.coalesce("last_line", F.lit(""))))
        .otherwise(
            _outcome("FAILURE", "NativePingFailure", _strip(F.coalesce("output", F.lit(""))))
        )
    )
    rows = runs.join(output, "run_id", "left").select(
        *RUN_COLUMNS,
        outcome.alias("outcome"),
        F.when(good, F.coalesce(F.col("latency").try_cast("double"), F.lit(0.0))).alias("latency_ms"),
    )
    return to_events(rows.select(*RUN_COLUMNS, "latency_ms", "outcome.*"), "ping", "Ping.Primary")


def internet_quality(samples: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Loss and mean latency per sample set; a null latency is a lost sample.

    The details show two decimals, halves rounded away from zero.
    """
    counted = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count("latency_ms").alias("good"),
        F.avg("latency_ms").alias("latency_ms"),
    )
    mean = F.col("latency_ms")
    # Only odd eighths lie exactly between two hundredths; the formatter rounds those to even.
    halfway = (mean * 8 == F.floor(mean * 8)) & (mean * 4 != F.floor(mean * 4))
    shown = F.format_number(F.when(halfway, mean + 0.0001).otherwise(mean), 2)
    details = F.concat(
        F.lit(QUALITY_MEAN),
        shown,
        F.lit(QUALITY_ACROSS),
        F.col("good").cast("string"),
        F.lit("/"),
        F.col("samples").cast("string"),
        F.lit(QUALITY_GOOD),
    )
    outcome = F.when(
        F.col("good") == 0, _outcome("FAILURE", "AllSamplesFailed", QUALITY_NONE)
    ).otherwise(_outcome("SUCCESS", None, details))
    return counted.withColumn("outcome", outcome).select(
        *keys,
        "latency_ms",
        ((F.col("samples") - F.col("good")) / F.col("samples") * 100).alias("loss"),
        "outcome.*",
    )


# -- dns ---------------------------------------------------------------------


def dns_events(runs: DataFrame, lines: DataFrame) -> DataFrame:
    """Outcome of a lookup.

    Outcome columns of ``runs``: ``tool`` (``dig`` or ``nslookup``), ``dns_server`` and
    ``error_text``. For dig the first line that is an address counts, for nslookup the last
    ``Address:`` line, which may be that of the server itself. A lookup by nslookup that
    prints no address at all ends in an error, one by dig is a failure.
    """
    stripped = _strip(F.col("line"))
    dig_line = F.regexp_like(stripped, F.lit(DIG_ADDRESS))
    address = F.regexp_extract("line", NSLOOKUP_ADDRESS, 1)
    output = lines.groupBy("run_id").agg(
        F.min_by(stripped, F.when(dig_line, F.col("line_no"))).alias("dig_address"),
        F.max_by(address, F.when(F.length(address) > 0, F.col("line_no"))).alias("nslookup_address"),
        F.expr(
            r"listagg(CASE WHEN line RLIKE '\\S' THEN line END, '\n') WITHIN GROUP (ORDER BY line_no)"
        ).alias("output"),
    )
    found = F.when(F.col("tool") == "dig", F.col("dig_address")).otherwise(F.col("nslookup_address"))
    outcome = (
        F.when(F.col("error_text").isNotNull(), _outcome("FATAL", "DnsQueryFailure", F.col("error_text")))
        .when(found.isNotNull(), _outcome("SUCCESS", None, F.concat(F.lit(DNS_RESOLVED), found)))
        .when(
            F.col("tool") == "nslookup",
            _outcome("FATAL", "DnsQueryFailure", DNS_NULL),
        )
        .otherwise(
            _outcome(
                "FAILURE",
                "NoAddress",
                F.coalesce(blank_to_null("output"), F.lit(DNS_NONE)),
            )
        )
    )
    rows = runs.join(output, "run_id", "left").withColumn("outcome", outcome)
    return to_events(rows.select(*RUN_COLUMNS, "dns_server", "outcome.*"), "dns", "DNS.Lookup")


# -- shares ------------------------------------------------------------------


def share_events(runs: DataFrame, lines: DataFrame, timeout_seconds: int = SHARE_TIMEOUT) -> DataFrame:
    """Outcome of a share probe; a run without a share id stands for a target without shares.

    Outcome columns of ``runs``: ``share_id``, ``share_path``, ``platform``, ``profile_id``,
    ``profile_mode``, ``has_smbclient``, ``has_kinit``, ``kinit_exit_code``, ``exit_code``,
    ``timed_out``, ``error_code`` and ``error_text``.
    """
    seen = lines.groupBy("run_id").agg(F.max(F.regexp_like("line", F.lit(r"\S"))).alias("any_text"))
    linux = F.col("platform") != "windows"
    mode = F.lower("profile_mode")
    keytab = linux & (mode == "kerberoskeytab")
    outcome = (
        F.when(
            F.col("share_id").isNull(),
            _outcome("SKIPPED", "NoSharesConfigured", SHARE_NONE),
        )
        .when(
            F.col("error_text").isNotNull(),
            _outcome("FATAL", F.coalesce("error_code", F.lit("ShareProbeFailure")), F.col("error_text")),
        )
        .when(
            linux & ~F.col("has_smbclient"),
            _outcome("SKIPPED", "SmbClientMissing", SHARE_NO_CLIENT),
        )
        .when(
            keytab & ~F.col("has_kinit"),
            _outcome("SKIPPED", "LinuxKinitMissing", SHARE_NO_KINIT),
        )
        .when(
            F.col("timed_out"),
            _outcome("TIMEOUT", "ShareTimeout", SHARE_LATE.format(timeout_seconds)),
        )
        .when(
            linux & ~mode.isin(*[known.lower() for known in schema.PROFILE_MODES]),
            _outcome("FAILURE", "LinuxAuthModeUnsupported", SHARE_MODE),
        )
        .when(
            keytab & (F.col("kinit_exit_code") != 0),
            _outcome(
                "FAILURE",
                "LinuxKerberosAcquireFailed",
                SHARE_NO_TICKET,
            ),
        )
        .when(
            linux & (F.col("exit_code") != 0),
            _outcome(
                "FAILURE",
                "LinuxShareAccessFailed",
                F.concat(F.lit(SHARE_EXIT), F.col("exit_code").cast("string"), F.lit(".")),
            ),
        )
        .when(
            F.coalesce("any_text", F.lit(False)), _outcome("SUCCESS", None, SHARE_DONE)
        )
        .otherwise(_outcome("EMPTY", None, SHARE_EMPTY))
    )
    metadata = F.to_json(
        F.struct(
            F.col("share_id").alias("shareId"),
            F.col("share_path").alias("sharePath"),
            F.when(F.col("share_id").isNotNull(), blank_to_null("profile_id")).alias("linuxProfileId"),
        )
    )
    rows = (
        runs.join(seen, "run_id", "left")
        .withColumns({"outcome": outcome, "metadata": metadata})
        .select(*RUN_COLUMNS, "metadata", "outcome.*")
    )
    return to_events(rows, "share", "Share.Access")


# -- domain authentication ---------------------------------------------------


def auth_events(runs: DataFrame, timeout_seconds: int = SHARE_TIMEOUT) -> DataFrame:
    """Outcome of a Kerberos check.

    Outcome columns of ``runs``: ``platform``, ``profile_id``, ``profile_mode``, ``has_klist``,
    ``has_kinit``, ``kinit_exit_code``, ``klist_exit_code``, ``timed_out``, ``error_code`` and
    ``error_text``.
    """
    mode = F.lower("profile_mode")
    keytab = mode == "kerberoskeytab"
    windows = F.col("platform") == "windows"
    outcome = (
        F.when(
            windows,
            _outcome(
                "SKIPPED",
                "DomainAuthUnsupportedPlatform",
                AUTH_PLATFORM,
            ),
        )
        .when(
            F.col("error_text").isNotNull(),
            _outcome("FATAL", F.coalesce("error_code", F.lit("DomainAuthProbeFailure")), F.col("error_text")),
        )
        .when(
            mode == "usernamepassword",
            _outcome(
                "SKIPPED",
                "DomainAuthUnsupportedProfileMode",
                AUTH_MODE,
            ),
        )
        .when(
            ~F.col("has_klist"),
            _outcome("SKIPPED", "LinuxKlistMissing", AUTH_NO_KLIST),
        )
        .when(
            keytab & ~F.col("has_kinit"),
            _outcome(
                "SKIPPED", "LinuxKinitMissing", AUTH_NO_KINIT
            ),
        )
        .when(
            F.col("timed_out"),
            _outcome("TIMEOUT", "DomainAuthTimeout", AUTH_LATE.format(timeout_seconds)),
        )
        .when(
            keytab & (F.col("kinit_exit_code") != 0),
            _outcome(
                "FAILURE",
                "LinuxKerberosAcquireFailed",
                AUTH_NO_TICKET,
            ),
        )
        .when(
            F.col("klist_exit_code") != 0,
            _outcome(
                "FAILURE",
                "LinuxKerberosTicketMissing",
                F.when(keytab, AUTH_KEYTAB_INVALID).otherwise(
                    AUTH_CACHE_INVALID
                ),
            ),
        )
        .otherwise(
            _outcome(
                "SUCCESS",
                None,
                F.when(keytab, AUTH_KEYTAB_DONE).otherwise(
                    AUTH_CACHE_DONE
                ),
            )
        )
    )
    profile = F.when(~windows, blank_to_null("profile_id"))
    rows = runs.withColumns(
        {"outcome": outcome, "metadata": F.to_json(F.struct(profile.alias("linuxProfileId")))}
    )
    return to_events(rows.select(*RUN_COLUMNS, "metadata", "outcome.*"), "domainAuth", "DomainAuth.Kerberos")


# -- inventory tags ----------------------------------------------------------


def tag_events(events: DataFrame, inventory: DataFrame) -> DataFrame:
    """Add the target's kind to event metadata, and ``targetClass`` for external targets.

    ``inventory`` has ``agent_id, target_id, target_kind``. Fields an event already has stay;
    a target that is not in the inventory is internal, one listed with both kinds is external.
    Metadata that is missing or no JSON object counts as an empty object.
    """
    document = F.try_parse_json("metadata")
    events = events.withColumn("metadata", F.when(is_object(document), F.col("metadata")).otherwise(F.lit("{}")))
    # A field counts as present even when its value is null.
    named = F.try_variant_get(document, "$.targetKind", "variant").isNotNull()
    kind = F.when(named, F.get_json_object("metadata", "$.targetKind")).otherwise(
        F.coalesce("inventory_kind", F.lit("internal"))
    )
    classed = F.try_variant_get(document, "$.targetClass", "variant").isNotNull()
    added = {
        "targetKind": F.when(~named, kind),
        "targetClass": F.when((kind == "external") & ~classed, F.lit("internet")),
    }
    # One row for each target, so that no event is repeated; "external" sorts before "internal".
    kinds = inventory.groupBy("agent_id", "target_id").agg(F.min("target_kind").alias("inventory_kind"))
    return (
        events.join(kinds, ["agent_id", "target_id"], "left")
        .withColumn("metadata", with_json_fields("metadata", added))
        .drop("inventory_kind")
    )
