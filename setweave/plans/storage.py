"""Tables in the folder that driver and executors share: written once, read again without their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_name() -> str:
    return uuid.uuid4().hex


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (a local session in a test) a temporary folder is made and set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not where:
        now = sc._jsc.sc().getCheckpointDir()
        where = now.get() if now.isDefined() else None
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="setweave-")
        sc.setCheckpointDir(where)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where if "://" in where or where.startswith("file:") else "file://" + where


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a table written once to the shared folder, without their lineage.

    Unlike ``checkpoint()`` this computes the last stage once only; a lost executor costs nothing
    that is already written.
    """
    path = f"{shared_dir(df.sparkSession)}/setweave/{new_name()}"
    df.write.parquet(path)
    return at(path, df.sparkSession.read.schema(df.schema).parquet(path))


def at(path: str, df: DataFrame) -> DataFrame:
    """``df``, which reads nothing but the table at ``path``, so that ``drop`` can delete that."""
    df._setweave_path = path
    return df


def drop(*tables: DataFrame | None) -> None:
    """Deletes what ``cut`` has written, once nothing will read it any more."""
    for df in tables:
        path = getattr(df, "_setweave_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
