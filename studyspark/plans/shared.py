"""Tables, the folder that all executors share, and cutting of lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package; once per Spark context."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="studyspark-")) / "studyspark.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(target))
    atexit.register(shutil.rmtree, target.parent, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and all runs on one machine, a new temporary folder.

    On a cluster without a shared folder this raises: a folder of the driver's machine would be another one on every executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="studyspark-checkpoint-")
        spark.sparkContext.setCheckpointDir(configured)
        atexit.register(shutil.rmtree, configured, True)
        configured = spark.sparkContext.getCheckpointDir() or configured
    return configured.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # the session is over; a local folder can still be removed
        shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)


#: Removes a query's shuffle files once it has ended; what is written to the shared folder doesn't need them any more.
_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffles of what is run inside are removed as soon as each query has ended; for results that are written or collected at once."""
    before = spark.conf.get(_CLEAN_SHUFFLES, None)
    spark.conf.set(_CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_SHUFFLES)
        else:
            spark.conf.set(_CLEAN_SHUFFLES, before)


class Kept:
    """Tables written to the shared folder, so that later jobs neither recompute them nor depend on any executor.

    Shuffles behind a written table are removed as soon as it is there. ``free`` removes tables that no later step reads; what is
    left goes when the process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/kept-{os.getpid()}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        atexit.register(_remove, spark, self.root)

    def __call__(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        smaller = "zstd" if any(kind == "string" for _, kind in df.dtypes) else "snappy"  # hashes don't get smaller
        with brief_shuffles(self.spark):
            df.write.option("parquet.enable.dictionary", "false").parquet(path, compression=smaller)  # hashes and texts hardly repeat
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = (table, path)
        return table

    def free(self, *tables: DataFrame) -> None:
        """Removes kept tables, given as they were returned; all that reads them must have been written or shown before."""
        for t in tables:
            found = self.paths.pop(id(t), None)
            if found is not None:
                _remove(self.spark, found[1])


def first_by_key(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key; redelivered rows repeat key and content, so any of them will do. Rows with a null key stay out."""
    kept = df.dropna(subset=list(keys))
    return kept.dropDuplicates(list(keys))


def code(column: str):
    """A code value without the freedom of writing: lower case, one ``-`` between words, no outer blanks; blank is null.

    Separators at the ends count as blanks.
    """
    c = F.regexp_replace(F.lower(F.col(column)), r"[\s_\-\x{a0}\x{2000}-\x{200b}\x{202f}\x{3000}\x{feff}]+", "-")
    c = F.regexp_replace(c, "^-|-$", "")
    return F.when(c != "", c)
