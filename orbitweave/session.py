"""Session helpers shared by the library: a local session for tests and benches, and durable cuts of lineage."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "orbitweave", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session with UTC time and adaptive execution, for tests and benches."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("ORBITWEAVE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


#: Folders of the runs that are open, the innermost last.
_RUNS: list[str] = []


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """A folder of one run below the shared one: all that is written inside the block is deleted at its end.

    Results must be taken, or written elsewhere, before that: they read what the run wrote.
    """
    outer, jvm = shared_dir(spark), spark.sparkContext._jvm
    folder = f"{outer}/run-{uuid.uuid4().hex}"
    before = spark.sparkContext.getCheckpointDir()
    _RUNS.append(folder)
    spark.sparkContext.setCheckpointDir(folder)
    try:
        yield folder
    finally:
        _RUNS.remove(folder)
        spark.sparkContext.setCheckpointDir(before.rpartition("/")[0] if before else outer)  # Spark makes a folder of its own below the one that is set
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the cluster names one.

    Only a session without that setting (a test on one machine) gets a temporary folder of its own. Inside a
    :func:`run_folder` it is the run's.
    """
    if _RUNS:
        return _RUNS[-1]
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: driver and executors need a folder that all of them reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="orbitweave-"))
    return spark.sparkContext.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so that later stages survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_file(spark: SparkSession, name: str, body: bytes) -> str:
    """Writes ``body`` to the shared folder and has Spark hand the file to each executor; its name there, for ``SparkFiles``."""
    name = f"{name}-{hashlib.sha256(body).hexdigest()[:16]}-{uuid.uuid4().hex[:8]}.bin"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(body)
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name
