"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a new one where that is unset, in local mode only.

    Executors of a cluster do not share local folders: without a shared one their rows would be lost.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-lorebase-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Tables that no block deletes: they last as long as the program that reads them.
_left: list[tuple[SparkSession, str]] = []


@atexit.register
def _leave() -> None:
    """Delete what is left when the program ends; a program that is killed leaves its tables, which are named ``lorebase-*``."""
    for spark, path in _left:
        try:
            place, store = _place(spark, path)
            store.delete(place, True)
        except Exception:  # noqa: BLE001  the JVM may be gone, and with it the way to the store
            return


#: Tables written so far inside each open ``scratch`` block, innermost last.
_open: list[list[str]] = []


def materialize(df: DataFrame, name: str, keep: bool = False, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    Inside a ``scratch`` block the table is deleted with the block, unless it is to be kept; what is left goes when the
    program ends.  ``by`` names a column whose
    values become folders, so a reader that wants some of them reads no others.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lorebase-{name}-{uuid.uuid4().hex}"
    if _open and not keep:
        _open[-1].append(path)
    else:
        _left.append((spark, path))
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(df: DataFrame, rows: int) -> int:
    """Tasks that hold about ``rows`` rows of df each; as many as Spark deals by itself at least, or a join would deal anew."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // rows + 1)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store its path names."""
    place, store = _place(spark, path)
    return bool(store.exists(place))


@contextmanager
def scratch(spark: SparkSession):
    """Delete what ``materialize`` writes inside the block when it ends.

    Results are lazy, so write what must stay to a place of its own before the block ends.
    """
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            place, store = _place(spark, path)
            store.delete(place, True)
