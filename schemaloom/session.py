"""Session defaults and the shared folder for cut lineage."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "*", partitions: int = 8, app: str = "schemaloom") -> SparkSession:
    """Session for tests and bench; on a cluster spark-submit supplies the master and the sizes."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="schemaloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def new_folder(spark: SparkSession) -> str:
    """A folder name below the shared folder that nothing uses yet."""
    return f"{shared_dir(spark).rstrip('/')}/schemaloom-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    Cuts the lineage so that the loss of an executor costs one stage, and unlike a checkpoint keeps
    the rows columnar and their size known to the optimizer.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: One byte of a file is about one byte of a row: no dictionaries, no compression.
PLAIN = {"compression": "none", "parquet.enable.dictionary": "false"}


def cut_plain(df: DataFrame) -> DataFrame:
    """As ``cut``, in files as large as the rows; for facts and keys, which compress by up to a hundred times.

    The optimizer takes the size of the files for the size of the rows. Of compressed files it would send millions
    of rows through the driver to be broadcast.
    """
    path = new_folder(df.sparkSession)
    df.write.options(**PLAIN).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """All shuffle partitions, also for few rows: for work that is heavy per row.

    Adaptive execution would merge partitions by their bytes, which are few for short texts. Rows that lie by the keys
    already, as those of an aggregate do, would be left where they are, so they are dealt out by a hash of their own.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))
