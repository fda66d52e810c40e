"""Session construction and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sitegauge")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver does.

    That serves local sessions and clusters that see the same folder; elsewhere the
    package is shipped with ``--py-files`` and this changes nothing.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder and read it from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a
    local session without that setting gets a folder of its own; a cluster
    session without it is an error, because a machine-local folder would not
    survive the loss of an executor.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if named:
            sc.setCheckpointDir(named)
        elif sc.master.startswith("local[") or sc.master == "local":
            folder = tempfile.mkdtemp(prefix=f"sitegauge-{os.getpid()}-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            sc.setCheckpointDir(folder)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return df.checkpoint(eager=True)
