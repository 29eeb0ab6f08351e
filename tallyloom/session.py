"""Session defaults: UTC, adaptive execution, Arrow. Sizes are left to the cluster."""

from __future__ import annotations

import atexit
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}
_made: dict[str, SparkSession] = {}


def session(app: str = "tallyloom", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in extra.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a temporary one on a single machine, an error on a cluster."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", known)
        _made[known] = spark
    return known.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _sweep() -> None:
    for path, spark in _made.items():
        try:
            delete(spark, path)
        except Exception:  # the session has ended: whoever owns the folder clears it
            return


atexit.register(_sweep)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the session's checkpoint folder, which all executors share: later steps read it there.

    Spark deletes the files once no plan reads them (``session`` asks for it); the driver's own checkpoint folder goes
    when the driver ends.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    _made.setdefault(context.getCheckpointDir(), df.sparkSession)
    return df.checkpoint()
