"""Intermediate tables that survive the loss of an executor.

Everything goes to the folder that the cluster names in
``spark.checkpoint.dir``; a folder of our own is set only where that setting
is absent (tests, a laptop).
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

#: Folders of our own, by application.
_OWN: dict[str, str] = {}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise RuntimeError(f"spark.checkpoint.dir is not set: on {master} intermediate tables need a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = f"file://{tempfile.mkdtemp(prefix='quillstone-')}"
            atexit.register(shutil.rmtree, _OWN[app].removeprefix("file://"), True)
        path = _OWN[app]
    return path.rstrip("/")


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, value)
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _dropping_shuffles(spark: SparkSession):
    """Shuffle files of a finished write are dead: let Spark drop them at once."""
    return _setting(spark, _CLEAN, "true")


def batch_rows(spark: SparkSession, rows: int):
    """Python gets at most ``rows`` rows at a time in what is written meanwhile."""
    now = int(spark.conf.get(_ROWS))
    return nullcontext() if 0 < now <= rows else _setting(spark, _ROWS, str(rows))


class Scratch:
    """Written tables of one operator run.

    ``keep(df)`` writes ``df`` as Parquet and returns the reread table, so its
    lineage ends at the files.  ``drop(table)`` deletes one at once; what is
    left goes when the Python process ends, because lazily evaluated results
    still read it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quillstone-{name}-{uuid.uuid4().hex[:12]}"
        self._paths: dict[int, str] = {}
        self._n = 0
        atexit.register(self._delete, self.root)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone already when the process ends
            pass

    def keep(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        with _dropping_shuffles(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(table)] = path
        table._scratch_path = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._delete(table._scratch_path)
