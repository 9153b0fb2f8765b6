"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A repeated JSON key keeps its last value instead of making the text "not JSON".
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set the run-time options the operators rely on."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``. Only a local-mode session without one gets a
    temporary folder; on a cluster executors could not share that, so it is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="logsift-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    _made.append(f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def clear_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables of this process; results that still read them can no longer be read."""
    jvm, gone = spark._jvm, 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone
