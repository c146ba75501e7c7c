"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Paths made inside each open owned() block, the innermost last.
_OWNED: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in local mode without one (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-cadenza-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for paths in _OWNED[-1:]:
        paths.append(path)
    return path


@contextmanager
def owned(spark: SparkSession) -> Iterator[list[str]]:
    """An owner of what is stored inside the block: at its end every table and file that library calls have put
    into the shared folder is deleted. Results that are to outlive the block are written or collected in it."""
    paths: list[str] = []
    _OWNED.append(paths)
    try:
        yield paths
    finally:
        _OWNED.remove(paths)
        for path in paths:
            _delete(spark, path)


def stored(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write `df` to the shared folder and read it back: later reads need no lost executor."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame | None) -> None:
    """Delete stored tables that nothing reads any more; None is passed over."""
    for table in tables:
        if table is None:
            continue
        for path in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)
