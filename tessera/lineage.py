"""Cutting the lineage of iterative jobs by tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}
#: The open records, the innermost last; each holds folders and the catalog table over them, if any.
_RECORDS: list[list[tuple[str, str | None]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a local session gets a temporary folder, once; on a cluster
    that is an error, since executors would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_DIRS:
            _OWN_DIRS[app] = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        named = _OWN_DIRS[app]
    return named.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written in the shared folder and read again; a lost executor costs only a re-read."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    recorded(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def recorded(path: str, table: str | None = None) -> None:
    """Note a folder in the innermost open record."""
    if _RECORDS:
        _RECORDS[-1].append((path, table))


@contextlib.contextmanager
def record() -> Iterator[list[tuple[str, str | None]]]:
    """What is written in the block, to be removed once nothing reads it any more."""
    _RECORDS.append([])
    try:
        yield _RECORDS[-1]
    finally:
        _RECORDS.pop()


def remove(spark: SparkSession, written_: list[tuple[str, str | None]]) -> None:
    """Remove recorded folders and their catalog tables."""
    for path, table in written_:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
