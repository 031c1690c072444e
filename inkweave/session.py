"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8, app: str = "inkweave") -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.inkweave.spread", cores if cores.isdigit() else "8")
        .getOrCreate()
    )


#: Tables whose rows are worth a core each: long texts.
TEXT_TABLES = ("documents", "pages")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Nothing is moved, unless the session asks for it.

    A table of texts in one small file is one split, so tests and benches on one machine set
    spark.inkweave.spread to deal it out over as many partitions; a cluster's tables have files
    enough and leave it unset.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    spread = int(spark.conf.get("spark.inkweave.spread", "0"))
    return df.repartition(spread) if spread and name in TEXT_TABLES else df


def shared_folder(spark: SparkSession) -> str:
    """The folder for what must outlive an executor: the one the cluster names in spark.checkpoint.dir.

    Only a session on one machine without it gets a temporary one.
    """
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="inkweave-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder on whatever file system it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, on whatever file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the session's checkpoint folder and read it back from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
