"""Intermediate tables that cut lineage, kept where every executor can read them.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that setting
is absent and the driver does all the work itself (tests, a laptop) a temporary folder of
this machine is used. All tables of an application lie below one folder, which ``clear``
removes: call it when a job's results are written.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_RUN = uuid.uuid4().hex[:12]


def _drop_local() -> None:
    for path in _LOCAL.values():
        shutil.rmtree(path, ignore_errors=True)


def folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; on a cluster it must be named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "path" not in _LOCAL:
        _LOCAL["path"] = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(_drop_local)
    return "file://" + _LOCAL["path"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/lodestone-{_RUN}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove all tables that this driver has kept; frames that read them can't be used any longer."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{folder(spark)}/lodestone-{_RUN}")
    top.getFileSystem(spark._jsc.hadoopConfiguration()).delete(top, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and return the written table.

    Unlike a cached or locally checkpointed frame, the result survives lost executors and
    its statistics are known to the planner.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
