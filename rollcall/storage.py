"""Where intermediate tables live: the folder that spark.checkpoint.dir names, which all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only where none is set and all workers are on this machine a temporary one is made."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='rollcall-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/rollcall-{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(clean)
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, lost executors cost nothing but a reread."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._rollcall_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing will read again."""
    path = getattr(df, "_rollcall_path", None)
    if path and (df.sparkSession, path) in _written:
        _written.remove((df.sparkSession, path))
        _delete(df.sparkSession, path)


def clean() -> None:
    """Delete the tables written by this driver; a session that has already stopped is left alone."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # the JVM may be gone at exit
            return


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_rollcall_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="rollcall-")) / "rollcall.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._rollcall_shipped = True
