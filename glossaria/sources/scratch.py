"""Tables that are asked more than once: written to the folder that the cluster shares, and read back."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; a temporary one only where none is set and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="glossaria-tables-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def written(df: DataFrame) -> DataFrame:
    """`df` as a table of the shared folder. Nothing is held in the session's storage, and a lost executor costs no more
    than its tasks; the caller deletes `table-*` folders after a job, as results are lazy."""
    path = f"{scratch_root(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
