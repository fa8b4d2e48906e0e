"""Small helpers that the training-data operators have in common."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white space characters, and a word as a run of anything else.
SPACES = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; the built-in lower() serves where all characters are ASCII."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    """The words of a text; none if it is null."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD), F.lit(0))


def free(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as keep it apart from all columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def work_dir(spark: SparkSession) -> str:
    """A new folder in the place that the cluster shares: spark.checkpoint.dir, or one of our own where that is unset and all runs in one process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends here and a lost executor costs no recomputation."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = 10_000, size: str = "2m"):
    """Bounds the Arrow batches of the jobs that run inside, by rows and by bytes; the session's own bounds come back after it.

    A result that is computed later has the session's bounds, which are 10,000 rows and 64 MB unless it states others.
    """
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(x) for x in names]
    for name, value in zip(names, (str(rows), size)):
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of a query that runs inside go when it has ended, not when the driver collects its garbage. Each
    DataFrame is to run once inside; what it gives is read from a written table."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sliced(batches, size: int = 1 << 20):
    """Batches in slices of rows of about so many bytes, so that what is made of one doesn't follow the session's batch size."""
    for batch in batches:
        n = max(1, min(batch.num_rows, -(-batch.nbytes // size)))
        step = max(1, -(-batch.num_rows // n))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def rows_wanted(df: DataFrame, rows_per_task: int, least: int = 12) -> int:
    """How many partitions hold df at that many rows each; df must be cheap to count, as a staged table is."""
    return max(least, -(-df.count() // rows_per_task))
