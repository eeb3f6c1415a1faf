"""Where intermediate tables go, and how much Arrow hands to Python at once.

Lineage is cut by writing Parquet tables to the shared folder in ``spark.checkpoint.dir``, so that a lost
executor costs a re-read and not a re-run. Only where that setting is absent (tests) a folder of our own is used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; else a temporary folder, which only a local session can use."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="papyra-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return _own[0]


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/papyra-{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write and read again."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that no DataFrame in use reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables that are written and read again, and deleted as soon as their successors are written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._held: list[tuple[DataFrame, str]] = []

    def cut(self, df: DataFrame, what: str = "cut") -> DataFrame:
        path = new_folder(self.spark, what)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._held.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables; nothing that is still to run may read them."""
        for df, path in self._held:
            if any(df is t for t in tables):
                drop_folder(self.spark, path)
        self._held = [(df, path) for df, path in self._held if not any(df is t for t in tables)]

    def drop_all(self, *but: DataFrame) -> None:
        self.drop(*(df for df, _ in self._held if not any(df is b for b in but)))


def free_names(df: DataFrame, *bases: str) -> list[str]:
    """Column names that df does not have in any case, one for each base."""
    have, out = {c.lower() for c in df.columns}, []
    for b in bases:
        while b.lower() in have:
            b += "_"
        have.add(b.lower())
        out.append(b)
    return out


def slices(offsets: np.ndarray, size: int = 4 << 20):
    """(from, to) positions of rows of at most so many bytes together, or of one longer row; offsets: row i's bytes begin at offsets[i]."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, j
        i = j


#: Rows up to which a table of ids is broadcast (16 to 32 MB); larger ones are joined by a shuffle.
FEW_IDS = 1 << 20


def if_few(ids: DataFrame) -> DataFrame:
    """ids, marked for broadcast where they are counted to be few."""
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids


def bounded(df: DataFrame, rows: int = 1024, size: str = "8m") -> DataFrame:
    """df in a session of its own, a clone of its session with these bounds on what Arrow gives to a Python worker at once.

    The caller's session keeps its settings, and whatever it sets later does not reach what is built on the result.
    """
    spark = df.sparkSession
    clone = spark._jsparkSession.cloneSession()
    clone.conf().set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    clone.conf().set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    plan = df._jdf.queryExecution().analyzed()
    made = spark.sparkContext._jvm.org.apache.spark.sql.classic.Dataset.ofRows(clone, plan)
    return DataFrame(made, SparkSession(spark.sparkContext, clone))
