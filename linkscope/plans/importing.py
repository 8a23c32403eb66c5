"""Import jobs: from batch sources to the stored tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from linkscope import schema
from linkscope.session import scratch, shared_folder, stage
from linkscope.sinks import lake as sink
from linkscope.sources import validate
from linkscope.sources.batches import BATCH_KEYS, LISTING_NO, BatchSource, in_sets, number_sets
from linkscope.sources.tables import Lake, new_batches

KEYS = list(BATCH_KEYS)


@dataclass(frozen=True)
class ImportResult:
    """What one run did with one source."""

    source_type: str
    run_id: str
    discovered: int
    imported: int
    skipped: int
    failed: int
    last_error: str | None
    last_source_identifier: str | None


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def _utc_literal(moment: datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp")


def check_lines(lines: DataFrame) -> DataFrame:
    """Typed event columns and an error text per non-blank line."""
    return validate.validate_events(validate.parse_lines(lines))


def judge_batches(spark: SparkSession, checked: DataFrame, pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The checked lines, stored, and one verdict per batch.

    Text is read and parsed once: the verdicts need three of the stored columns, and the events
    come from columnar files.
    """
    folder = shared_folder(spark, "checked")
    checked = stage(checked, f"{folder}/lines")
    return checked, stage(validate.gate_batches(checked, pending), f"{folder}/verdicts")


def pending_batches(listing: DataFrame, ledger: DataFrame, folder: str) -> DataFrame:
    """The listed batches that are not in the ledger, each once.

    ``listing`` was stored with its numbers. Only keys and numbers are shuffled; what else a batch brings, such as
    its text, is neither shuffled nor stored again.
    """
    new = new_batches(listing.select(*KEYS, LISTING_NO), ledger)
    chosen = new.groupBy(*KEYS).agg(F.min(LISTING_NO).alias(LISTING_NO))
    return in_sets(listing, stage(number_sets(chosen), folder))


def store_batches(lake: Lake, checked: DataFrame, verdicts: DataFrame, run_id: str, at: datetime) -> None:
    """Write the events of good batches, then their ledger rows."""
    good = verdicts.filter(F.col("error").isNull())
    if not good.isEmpty():
        if LISTING_NO in checked.columns and LISTING_NO in verdicts.columns:
            sets = stage(number_sets(good), shared_folder(good.sparkSession, "good"))
            events = in_sets(checked, sets).drop("error")
        else:
            events = validate.accepted_events(checked, verdicts)
        sink.append_events(lake, sink.with_lineage(events), run_id)
        sink.append_ledger(
            lake, good.withColumns({"imported_utc": _utc_literal(at), "run_id": F.lit(run_id)})
        )


def commit_batches(
    spark: SparkSession, lake: Lake, checked: DataFrame, pending: DataFrame, run_id: str, at: datetime
) -> DataFrame:
    """Judge batches and store the good ones; return all verdicts."""
    checked, verdicts = judge_batches(spark, checked, pending)
    store_batches(lake, checked, verdicts, run_id, at)
    return verdicts


def run_record(
    verdicts: DataFrame, listing: DataFrame, source_type: str, run_id: str, at: datetime
) -> DataFrame:
    """The one-row log entry of an import run.

    ``listing`` has one row per discovered batch, ``verdicts`` one per batch not skipped. Both
    go through a single aggregation.
    """
    order = F.struct("source_identifier", "fingerprint")
    seen = listing.select("source_identifier", "fingerprint", F.lit(None).cast("string").alias("error"), F.lit(False).alias("tried"))
    tried = verdicts.select("source_identifier", "fingerprint", "error", F.lit(True).alias("tried"))
    is_tried, failed = F.col("tried"), F.col("error").isNotNull()
    totals = seen.unionByName(tried).agg(
        F.count_if(~is_tried).alias("discovered"),
        F.count_if(is_tried & ~failed).alias("imported"),
        F.count_if(failed).alias("failed"),
        F.max_by("error", F.when(failed, order)).alias("last_error"),
        F.max("source_identifier").alias("last_source_identifier"),
    )
    return totals.select(
        F.lit(run_id).alias("run_id"),
        F.lit(source_type).alias("source_type"),
        _utc_literal(at).alias("run_utc"),
        "discovered",
        "imported",
        (F.col("discovered") - F.col("imported") - F.col("failed")).alias("skipped"),
        "failed",
        F.col("failed").alias("backlog"),
        "last_error",
        "last_source_identifier",
        F.when(F.col("imported") > 0, _utc_literal(at)).alias("last_imported_batch_utc"),
    )


def failed_run_record(
    spark: SparkSession, source_type: str, run_id: str, at: datetime, error: str, discovered: int = 0, failed: int = 1
) -> DataFrame:
    """The log entry of a run that could not be finished."""
    row = (run_id, source_type, at, discovered, 0, max(0, discovered - failed), failed, failed, error, None, None)
    return spark.createDataFrame([row], schema.IMPORT_RUN_SCHEMA)


def import_source(
    spark: SparkSession, lake: Lake, source: BatchSource, as_of: datetime | None = None
) -> ImportResult:
    """Import what is new in one source, and log the run.

    A batch is imported whole or not at all. A failed batch stays out of the ledger, so every
    later run tries it again and counts it again. A source that cannot be listed or read is an
    outcome as well: it is logged, all its new batches count as failed, and nothing of it is committed. A run that
    reached the ledger is logged as what it committed; if the log cannot be written, the call fails, and the
    ledger still holds the run.
    """
    at = as_of or utc_now()
    run_id = uuid.uuid4().hex
    discovered, tried = 0, 1
    with scratch(spark, f"import-{run_id}"):
        try:
            folder = shared_folder(spark, "listing")
            listed = source.batches(spark).withColumn(LISTING_NO, F.monotonically_increasing_id())
            listing = stage(listed, f"{folder}/listing")
            # A source may list the same batch twice; the second one counts as skipped.
            pending = pending_batches(listing, lake.ledger(spark), f"{folder}/pending")
            discovered, tried = listing.count(), pending.count()
            checked, verdicts = judge_batches(spark, check_lines(source.lines(spark, pending)), pending)
            outcome = run_record(verdicts, listing, source.source_type, run_id, at).first()
            store_batches(lake, checked, verdicts, run_id, at)
        except Exception as error:  # an unreadable source does not stop the others
            if not committed(spark, lake, run_id):
                outcome = failed_run_record(
                    spark, source.source_type, run_id, at, str(error), discovered, tried if discovered else 1
                ).first()
        # Outside of the block above: the log says what was committed, whatever happens to the log itself.
        return log_run(spark, lake, outcome)


def committed(spark: SparkSession, lake: Lake, run_id: str) -> bool:
    """Whether the ledger holds batches of a run; a commit writes its rows last and all at once."""
    return not lake.ledger(spark).filter(F.col("run_id") == run_id).isEmpty()


# Attempts to write the log entry of a run.
LOG_ATTEMPTS = 3


def log_run(spark: SparkSession, lake: Lake, row: Row) -> ImportResult:
    """Append the log entry, trying again where the store fails, and return what it says."""
    entry = spark.createDataFrame([tuple(row)], schema.IMPORT_RUN_SCHEMA)
    for attempt in range(LOG_ATTEMPTS):
        try:
            sink.append_import_run(lake, entry)
            break
        except Exception:
            if attempt + 1 == LOG_ATTEMPTS:
                raise
    return ImportResult(
        row.source_type,
        row.run_id,
        row.discovered,
        row.imported,
        row.skipped,
        row.failed,
        row.last_error,
        row.last_source_identifier,
    )


def import_all(
    spark: SparkSession, lake: Lake, sources: Iterable[BatchSource], as_of: datetime | None = None
) -> list[ImportResult]:
    """One import cycle over all sources, in order."""
    return [import_source(spark, lake, source, as_of) for source in sources]


def ingest_envelopes(
    spark: SparkSession, lake: Lake, bodies: DataFrame, as_of: datetime | None = None
) -> int:
    """Store the events of ``{"events": [...]}`` request bodies; returns how many.

    ``bodies`` has ``source_identifier`` and ``body``. One bad event, or none, fails the call
    and stores nothing.
    """
    at = as_of or utc_now()
    run_id = uuid.uuid4().hex
    requests = bodies.select(
        F.lit("ingest").alias("source_type"),
        "source_identifier",
        F.concat(F.lit(f"{run_id}-"), F.sha2("body", 256)).alias("fingerprint"),
        "body",
    )
    with scratch(spark, f"ingest-{run_id}"):
        checked, verdicts = judge_batches(
            spark, validate.validate_events(validate.envelope_events(requests)), requests
        )
        bad = verdicts.filter(F.col("error").isNotNull()).first()
        if bad is not None:
            torn = requests.filter(F.try_parse_json("body").isNull()).first()
            reason = validate.BROKEN_BODY if torn is not None else bad.error
            raise ValueError(f"{(torn or bad).source_identifier}: {reason}")
        store_batches(lake, checked, verdicts, run_id, at)
        return verdicts.agg(F.sum("event_count")).first()[0] or 0
