"""Session settings the library depends on, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    # Day and bucket boundaries are UTC.
    "spark.sql.session.timeZone": "UTC",
    # A JSON object may repeat a key; the last value counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # The INT96 default carries no min/max statistics, so nothing could be skipped.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.adaptive.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator of this library relies on."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, named by ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder; a cluster session does not,
    because executors on other machines could not read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
    application = spark.sparkContext.applicationId
    if application not in _local_dirs:
        _local_dirs[application] = tempfile.mkdtemp(prefix="tallylog-")
    return _local_dirs[application]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder with all in it, in whatever store it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    folder.getFileSystem(conf).delete(folder, True)


def settle(df: DataFrame) -> DataFrame:
    """``df`` with its rows and their placement written once to the shared folder.

    For steps that read each other's rows lazily: Spark knows when nobody reads them any more and
    then removes them, if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder; (the rows read back, their folder).

    The caller removes the folder where it can tell that nobody reads it any more.

    Used where several steps must see one and the same row placement (range partition numbers),
    which a recomputed plan does not promise. It survives the loss of any executor.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
