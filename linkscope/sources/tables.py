"""The stored tables of one telemetry lake folder.

* ``events``  - event rows, partitioned by ``event_date``, each with the run that wrote it
* ``ledger``  - one row per imported batch, written after its events
* ``import_runs`` - one row per source and import run
* ``packs/events``, ``packs/replaced``, ``packs/log`` - small event files packed into larger ones: the rows, the
  files that they stand for, and one entry per packing, written last

An import run writes its events first and its ledger rows last. Readers keep only events of
the batches that the ledger knows of that run, so what a lost driver left behind is never seen, and
the next run simply imports those batches again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscope import schema
from linkscope.session import file_names

FILE_FIELDS = [T.StructField("file_name", T.StringType()), T.StructField("file_size", T.LongType())]


def read_or_empty(spark: SparkSession, path: str, table_schema: T.StructType) -> DataFrame:
    """A Parquet table, or no rows when nothing was written yet."""
    try:
        return spark.read.schema(table_schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], table_schema)


def _read_files(spark: SparkSession, path: str, table_schema: T.StructType) -> DataFrame:
    """A Parquet table with ``file_name`` and ``file_size`` of the file of each row."""
    try:
        rows = spark.read.schema(table_schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType(table_schema.fields + FILE_FIELDS))
    return rows.withColumns({name: F.col(f"_metadata.{name}") for name in ("file_name", "file_size")})


@dataclass(frozen=True)
class Lake:
    root: str

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def ledger(self, spark: SparkSession) -> DataFrame:
        return read_or_empty(spark, self.path("ledger"), schema.LEDGER_SCHEMA)

    def import_runs(self, spark: SparkSession) -> DataFrame:
        return read_or_empty(spark, self.path("import_runs"), schema.IMPORT_RUN_SCHEMA)

    def events(self, spark: SparkSession, dedupe: bool = False) -> DataFrame:
        """Committed events. ``dedupe`` drops repeats of a re-imported, grown file.

        A batch counts once, with the run that committed it first, whoever else stored it: a run that was
        lost halfway through its ledger rows, or two runs at the same time, add nothing.
        """
        committed = (  # the ledger is listed before the events that it stands for
            self.ledger(spark)
            .groupBy("source_type", "source_identifier", "fingerprint")
            .agg(F.min_by("run_id", F.struct("imported_utc", "run_id")).alias("run_id"))
            .select("run_id", batch_id().alias("batch_id"))
        )
        rows = self.stored_events(spark).select(*schema.STORED_EVENT_SCHEMA.names)
        rows = rows.join(committed, ["run_id", "batch_id"], "left_semi")
        return rows.dropDuplicates(list(schema.EVENT_COLUMNS)) if dedupe else rows

    def pack_log(self, spark: SparkSession) -> DataFrame:
        """pack_id and packed_utc of every committed packing."""
        return spark.read.schema(schema.PACK_LOG_SCHEMA).json(self.path("packs/log"))

    def stored_events(self, spark: SparkSession) -> DataFrame:
        """Every stored row once, committed or not, with ``file_name``, ``file_size`` and ``source_pack`` of its file.

        Rows lie in the files of import runs or in those of a packing. What a packing replaced counts no more from
        its log entry on. The log is listed before the files: a packing that commits in between is not seen,
        and the files it replaces are.
        """
        if not file_names(spark, self.path("packs/log")):
            return _read_files(spark, self.path("events"), schema.STORED_EVENT_SCHEMA).withColumn("source_pack", F.lit(""))
        log = self.pack_log(spark)
        replaced = read_or_empty(spark, self.path("packs/replaced"), schema.REPLACED_SCHEMA)
        rows = _read_files(spark, self.path("events"), schema.STORED_EVENT_SCHEMA).withColumn("source_pack", F.lit(""))
        packed = _read_files(spark, self.path("packs/events"), schema.PACKED_EVENT_SCHEMA)
        packed = packed.join(log, "pack_id", "left_semi").withColumnRenamed("pack_id", "source_pack")
        gone = replaced.join(log, "pack_id", "left_semi")
        keys = ["source_pack", "event_date", "file_name"]
        return rows.unionByName(packed).join(gone.select(*keys), keys, "left_anti")

    def last_import(self, spark: SparkSession) -> DataFrame:
        """Newest import time per source."""
        return last_import(self.ledger(spark))


def batch_id() -> Column:
    """Lineage text of a batch; sorts by source, then path."""
    return F.concat(F.col("source_type"), F.lit(":"), F.col("source_identifier"), F.lit("@"), F.col("fingerprint"))


def last_import(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("source_type").agg(F.max("imported_utc").alias("last_imported_utc"))


def new_batches(batches: DataFrame, ledger: DataFrame) -> DataFrame:
    """Batches whose source, identifier and fingerprint are not in the ledger."""
    keys = ["source_type", "source_identifier", "fingerprint"]
    return batches.join(ledger.select(*keys), keys, "left_anti")
