"""Where jobs keep what they cut their lineage with."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where a session on one machine names none (tests), a temporary folder is made once and set as the checkpoint folder;
    a session on a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-corpuslens-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{_made(spark)}/{uuid.uuid4().hex}/{name}"


def _made(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/corpuslens/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Remove what the jobs of this application have left in the shared folder. Results that aren't written elsewhere yet are lost."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(_made(spark))
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later steps need neither its inputs nor the executors that made it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows go to Python workers in batches of so many bytes, unless the session says otherwise: texts can be very long.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Let Python workers that start from another folder import this package, and bound what they get at once."""
    if int(spark.conf.get(_BATCH, str(2**31 - 1))) >= 64 << 20:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def ship_to_active() -> None:
    """ship_package() for functions that make columns and have no DataFrame at hand."""
    if (spark := SparkSession.getActiveSession()) is not None:
        ship_package(spark)
