"""Session plumbing shared by every operator: tables, shared folders, code shipping."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read only through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application.

    Executors may have no copy of the repository, so the package travels as a zip
    served by the driver.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # already running from the shipped zip
        return
    folder = tempfile.mkdtemp(prefix="quillstone-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "quillstone_code.zip")
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    Path(target).write_bytes(held.getvalue())
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def once(udf):
    """A Python function that the optimizer may not copy.

    Filters and projections over its output would otherwise each run it again.
    """
    return udf.asNondeterministic()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: spark.checkpoint.dir.

    Only where Spark runs on one machine (tests, a laptop) and names none a temporary folder is set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quillstone-shared-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
        return "file://" + named if named.startswith("/") else named
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/quillstone-{label}-{uuid.uuid4().hex}"


_SETTLED: list[str] = []


def settle(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts lineage on storage that survives a lost executor, and stops an
    expensive input from being computed twice. `forget` deletes all such tables.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.options(**options).parquet(path)
    _SETTLED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> int:
    """Delete every table that settle() wrote for this driver, once results are written; returns how many.

    A result is lazy and may still read settled tables, so the caller says when.
    """
    jvm, done = spark.sparkContext._jvm, 0
    while _SETTLED:
        path = jvm.org.apache.hadoop.fs.Path(_SETTLED.pop())
        done += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return done


def discard(df: DataFrame) -> None:
    """Delete the files behind a table made by settle() that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if "/quillstone-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
