"""Written intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master may go without that setting: it then gets one temporary folder for the
    session. A cluster without it is an error, since its executors share no local folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="panelyard-")
    return "file://" + _LOCAL[sc.applicationId]


def table_path(spark: SparkSession, tag: str) -> str:
    """A fresh path for one intermediate table."""
    return f"{shared_dir(spark)}/panelyard/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts lineage, so losing an executor later costs a re-read and not a recomputation, and it
    gives the planner true sizes. The files stay until :func:`drop` or until the folder is cleaned.
    """
    spark = df.sparkSession
    path = table_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._panelyard_path = path
    return out


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put before those that ``df`` has, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


@contextmanager
def workspace() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """:func:`written` for tables that nothing reads once the block is left; their files are then deleted."""
    tables: list[DataFrame] = []

    def keep(df: DataFrame, tag: str) -> DataFrame:
        tables.append(written(df, tag))
        return tables[-1]

    try:
        yield keep
    finally:
        for table in tables:
            drop(table)


def drop(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`written`; call only once nothing reads it."""
    path = getattr(df, "_panelyard_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
