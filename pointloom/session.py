"""Sessions, and the package for a cluster's Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


#: Rows and bytes that one Arrow batch may hold, where the session does not say: a batch of long texts
#: is held several times over by the JVM and a Python worker.
ARROW_ROWS, ARROW_BYTES = "2000", str(8 << 20)


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's Python workers, once, through Spark's own file server, so
    that they need no copy of the repository. Bounds Arrow batches where the session does not."""
    sc = spark.sparkContext
    for name, value in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    if getattr(sc, "_pointloom_sent", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="pointloom-"), "pointloom.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in sorted(os.walk(home)):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    out.write(full, os.path.join("pointloom", os.path.relpath(full, home)))
    sc.addPyFile(path)
    sc._pointloom_sent = True


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share. Where it is unset a
    temporary one is made for a session on one machine; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="pointloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def local_session(cores: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine, for tests and measurements."""
    build = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
    build = build.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    for k, v in conf.items():
        build = build.config(k.replace("__", "."), v)
    spark = build.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
