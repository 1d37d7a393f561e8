"""Session helpers: settings, checkpoint folder and table access."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def share_package(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver has it; a cluster without that path gets it by --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *known])


def local_session(name: str = "loupe", cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    share_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a local one only where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="loupe-checkpoints-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint that survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_TABLES: list = []


def _remove_tables() -> None:
    for path, conf in _TABLES:
        try:
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # noqa: BLE001, the JVM may be gone at the end of the process
            return


def scratch(spark: SparkSession) -> str:
    """A new folder in the checkpoint folder, which goes at the end of the process."""
    folder = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    if not _TABLES:
        atexit.register(_remove_tables)
    _TABLES.append((spark._jvm.org.apache.hadoop.fs.Path(folder), spark._jsc.hadoopConfiguration()))
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written into the checkpoint folder: compressed, and read by columns."""
    spark = df.sparkSession
    folder = scratch(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
