"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir.

A written table ends the lineage: plans stay small however many steps follow, and a lost executor costs nothing.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class NoSharedFolder(RuntimeError):
    """A cluster without a folder that all its machines share."""


_LOCAL: dict[str, str] = {}  # application -> its own folder, of local sessions without the setting
ROWS = "rows"
_COUNTS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()  # kept table -> its observation, and what that counts
_TABLES: dict[str, list[str]] = {}  # application -> paths of its tables, in the order they were written


def shared_folder(spark: SparkSession) -> str:
    """The session's setting. Where it is unset: a temporary folder of our own if driver and executors are one process,
    else an error, as executors can't read each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="corbel-")
    return _LOCAL[app]


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark)}/corbel-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Deletes what this application has kept. Results that still read it must be written before."""
    _delete(spark, own_folder(spark))
    _TABLES.pop(spark.sparkContext.applicationId, None)


def keep(df: DataFrame, tag: str = "kept") -> DataFrame:
    """df written as Parquet and read again."""
    spark, schema = df.sparkSession, df.schema
    path = f"{own_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(schema).parquet(path)


def keep_counted(df: DataFrame, **counts: Column) -> DataFrame:
    """As keep; its rows, and counts by name, are taken while it is written. kept_counts gives them."""
    seen = Observation()
    out = keep(df.observe(seen, F.count(F.lit(1)).alias(ROWS), *[c.alias(name) for name, c in counts.items()]))
    _COUNTS[out] = seen, [ROWS, *counts]
    return out


def kept_counts(df: DataFrame) -> dict[str, int]:
    """What keep_counted has counted in a table that it returned, without reading it."""
    seen, names = _COUNTS[df]
    try:
        return dict(seen.get)
    except Py4JJavaError:  # the optimizer saw that there are no rows, and ran nothing
        return dict.fromkeys(names, 0)


def kept_rows(df: DataFrame) -> int:
    return kept_counts(df)[ROWS]


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables kept within are deleted at the end, but for those whose paths are put into the list."""
    mine = _TABLES.setdefault(spark.sparkContext.applicationId, [])
    first, spared = len(mine), []
    yield spared
    for path in mine[first:]:
        if path not in spared:
            _delete(spark, path)
    mine[first:] = [p for p in mine[first:] if p in spared]


def last_kept(spark: SparkSession) -> str:
    """Path of the table that was kept last."""
    return _TABLES[spark.sparkContext.applicationId][-1]


def discard(spark: SparkSession, path: str) -> None:
    """Deletes one kept table that nothing reads any more."""
    _delete(spark, path)
    _TABLES[spark.sparkContext.applicationId].remove(path)
