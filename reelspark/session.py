"""Session factory and lineage cuts.

``session()`` is for tests and the bench; on a cluster the caller brings the
session.  ``Shelf`` writes intermediate tables to the shared folder named in
``spark.checkpoint.dir`` so that a lost executor loses nothing.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests rely on (UTC, AQE)."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("reelspark")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("REELSPARK_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session's executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="reelspark-ship-")) / "reelspark.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    sc.addPyFile(str(target))  # served by the driver, so no shared folder is needed
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of the data folder (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: the session's setting; else, on a local master only, a temporary one."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="reelspark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


class Shelf:
    """Named intermediate tables of one operator run, as parquet in the shared folder.

    ``put`` writes a frame once and gives back a frame that reads it, so later
    plans start from files instead of recomputing.  ``drop`` removes a table no
    later plan needs; the rest goes when the JVM ends.
    """

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/reelspark-{what}-{uuid.uuid4().hex[:12]}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def free(self) -> None:
        """Let go of the shuffle files of tables that are written: Spark removes them when the driver collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
