"""Session helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark import SparkContext
from pyspark.sql import SparkSession


def own_folder(sc: SparkContext) -> str:
    """A folder for checkpoints where spark.checkpoint.dir is unset; only one JVM can do with a local one, and it goes with it."""
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="conspectus-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; in one JVM (tests), where it is unset, one of our own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        root = own_folder(sc)
        sc.setCheckpointDir(root)
    return root


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of all executors, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_conspectus_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp()  # read by the driver alone, which hands it to executors until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "conspectus.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("conspectus", os.path.relpath(full, top)))
    sc.addPyFile(path)
    sc._conspectus_shipped = True


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_session(app: str = "conspectus", **conf: str) -> SparkSession:
    """A session with what the engine relies on: UTC, adaptive execution, checkpoints that go when nothing refers to them."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
