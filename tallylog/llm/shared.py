"""Help that several operators of this folder use: shared folders, tables, text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text worked on at once inside a task; one longer text is worked on alone.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or for a local session without it a
    temporary folder. A cluster session without the setting is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="tallylog-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Spark's setting by which a query's shuffle files go when it ends, not when the driver collects.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """The frame with its rows written to the shared folder and its lineage cut there.

    The shuffles made for it are removed with that, as nothing reads them again: otherwise they
    lie on the disks until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # the setting holds for plans made under it
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder name inside the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder with all in it, in whatever store it lies."""
    jvm, session = spark.sparkContext._jvm, spark._jsparkSession
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


def whole_text(column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left.join(right, keys, how) for a right side that is an aggregate by these keys.

    Spark would deal the left side out as the aggregate is, and then cannot split the task of a
    key with very many rows. With rewritten keys both sides are dealt out for the join, and skewed
    tasks are split. Keys are longs, strings or binary; a null key joins nothing.
    """
    kinds, own = dict(right.dtypes), dict(left.dtypes)
    # a long is made again from its rewritten form, so that it is dealt out once
    longs = {c: f"_key{i}" for i, c in enumerate(keys) if kinds[c] == own[c] == "bigint"}
    rewrite = lambda c: F.bitwise_not(c) if kinds[c] == "bigint" else F.hex(c)
    names = [f"_key{i}" for i in range(len(keys))]
    rewritten = [rewrite(c).alias(n) for c, n in zip(keys, names)]
    one = left.select(*[c for c in left.columns if c not in longs], *rewritten)
    other = right.select(*[c for c in right.columns if c not in keys], *rewritten)
    joined = one.join(other, names, how)
    back = [F.bitwise_not(longs[c]).alias(c) if c in longs else F.col(c) for c in left.columns]
    return joined.select(*back, *[c for c in joined.columns if c not in names and c not in left.columns])


def row_key(id_column: str = "doc_id", text_column: str = "text") -> list[Column]:
    """Columns k_id and k_th that tell rows apart: the id (null has a value of its own) and a
    digest of the text, so that rows which share an id but not a text stay apart."""
    return [
        F.coalesce(F.col(id_column).cast("long"), F.lit(-(2**63))).alias("k_id"),
        F.xxhash64(whole_text(text_column)).alias("k_th"),
    ]


def binary(column: pa.Array) -> pa.Array:
    """A string column as bytes with 64-bit offsets; null becomes empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    return column.cast(pa.large_binary()).fill_null(b"")


def text_slices(
    column: pa.Array, slice_bytes: int = SLICE_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of a text column as (first row, end row, their bytes, row offsets in these)."""
    column = binary(column)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = int(np.searchsorted(at, at[low] + slice_bytes, "right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high, bytes_[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high
