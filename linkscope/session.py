"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

# Runtime settings; each can be changed on a live session.
SETTINGS = {
    # All event times are UTC instants.
    "spark.sql.session.timeZone": "UTC",
    # Run-time plans: coalesce small partitions, split skewed ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Larger generated methods are never compiled to machine code; run those operators
    # one by one instead of fused.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Tasks cut their rows to the first n of a group before the shuffle up to this n (1000 as Spark comes).
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    # A repeated JSON key keeps its last value instead of failing the line.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


# Folder of the job that runs now; intermediate tables go below it.
_SCRATCH: ContextVar[str | None] = ContextVar("linkscope-scratch", default=None)
# One temporary folder per local application that names no folder of its own.
_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name that every executor can reach.

    The parent is the cluster's ``spark.checkpoint.dir``. Without that setting a local session
    gets a temporary folder; a cluster session raises, as its executors share no local disk.
    """
    if _SCRATCH.get():
        return f"{_SCRATCH.get()}/{label}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="linkscope-")
        base = _LOCAL_FOLDERS[context.applicationId]
    return f"{base.rstrip('/')}/linkscope/{label}-{uuid.uuid4().hex}"


def stage(frame: DataFrame, path: str) -> DataFrame:
    """Store an intermediate table, packed tightly as it is read once or twice only; returns what was stored."""
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data, wherever it lives."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def numbered_folders(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Numbers of the complete ``kind=number`` folders below a folder, ascending, by kind."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = hadoop_path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {}
    if store.exists(root):
        for entry in store.listStatus(root):
            kind, _, number = entry.getPath().getName().partition("=")
            if number.isdecimal() and store.exists(hadoop_path(entry.getPath(), "_SUCCESS")):
                found.setdefault(kind, []).append(int(number))
    return {kind: sorted(numbers) for kind, numbers in found.items()}


def claim_file(spark: SparkSession, path: str, line: str) -> bool:
    """Create a file of one ASCII line; False where another driver created it before."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = store.create(jvm_path, False)
    except Py4JJavaError:
        if store.exists(jvm_path):
            return False
        raise
    out.writeBytes(line + "\n")
    out.close()
    return True


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, ascending; none where it does not exist. For folders with few entries."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(entry.getPath().getName() for entry in store.listStatus(root)) if store.exists(root) else []


@contextmanager
def scratch(spark: SparkSession, label: str) -> Iterator[None]:
    """Shared folders taken inside lie below one folder, which is deleted at the end.

    For jobs that store their results themselves: no frame may leave the block unread.
    """
    folder = shared_folder(spark, label)
    token = _SCRATCH.set(folder)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        remove_folder(spark, folder)
