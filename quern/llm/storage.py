"""Where the operators of this package keep tables and files that outlive a task.

Everything goes below ``spark.checkpoint.dir``, the one folder that the driver and all executors
share.  A table written there cuts lineage: when an executor is lost, later stages read the files
again and nothing has to be recomputed from the sources.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session.  Where none is configured, a session on one machine gets a
    temporary one; on a cluster that is an error, since no folder of the driver is everyone's."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="quern-shared-")
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path (not created yet) in the shared folder."""
    return f"{shared_dir(spark)}/quern-{label}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``new_folder`` once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Rows of an Arrow batch, and Spark's own number: a batch of whole documents must stay small.
BATCH_ROWS, DEFAULT_ROWS = 512, "10000"


def small_batches(spark: SparkSession) -> None:
    """Python workers get few rows at a time, unless the session says itself how many."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == DEFAULT_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores behind it until no column is called so."""
    while name.lower() in (c.lower() for c in columns):
        name += "_"
    return name


#: Shuffle files of a query go when it ends instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows of a file of a table whose number of rows is known.
ROWS_PER_FILE = 1_000_000


def write_table(df: DataFrame, label: str, *partition_by: str, rows: int | None = None) -> str:
    """Write ``df`` as Parquet into the shared folder and return the path.

    Every partition that has rows writes a file.  For a table of narrow rows that many small partitions
    make, ``rows`` says about how many there are: the work stays in its partitions, and one more shuffle
    deals what they return to as many files as that takes, one per core at least."""
    spark = df.sparkSession
    if rows is not None:
        df = df.repartition(max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_FILE)))
    path, before = new_folder(spark, label), spark.conf.get(CLEANUP, None)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    spark.conf.set(CLEANUP, "true")  # what is written is read from its files, never from its shuffles
    try:
        writer.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return path


def materialize(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """``df`` as a written table: same rows and schema, lineage cut, safe against lost executors.
    ``rows`` as for ``write_table``."""
    small_batches(df.sparkSession)
    schema, path = df.schema, write_table(df, label, rows=rows)
    table = df.sparkSession.read.schema(schema).parquet(path)
    table.quern_folder = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    for table in tables:
        drop_folder(table.sparkSession, table.quern_folder)
