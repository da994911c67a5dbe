"""The shared folder for work tables and checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    Unset, a local session (one machine, as in tests) gets a temporary folder of its own; on a
    cluster that is an error, as executors and driver would not see each other's files. No setting
    of the session is changed.
    """
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if folder:
        return folder.rstrip("/")
    if not _is_local(spark.sparkContext.master):
        raise RuntimeError(f"{SETTING} must name a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = tempfile.mkdtemp(prefix="logmere-")
    return _LOCAL[application]


def _is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def prepare_checkpoints(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, used by nobody else."""
    return f"{shared_folder(spark)}/logmere/{name}-{uuid.uuid4().hex}"
