"""Shipping this package to the executors, and folders they share with the driver."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package's own source as a zip to the Spark context, once, so that Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="meridian-src-")
        path = shutil.make_archive(os.path.join(folder, "meridian"), "zip", os.path.dirname(here), os.path.basename(here))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and driver and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="meridian-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``shared_root``; it is deleted when the session's JVM ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of its file system, for tasks that open files themselves."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def store(uri: str):
    """The pyarrow file system of a qualified path, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
