"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the 29 characters that Python's str.split() takes as whitespace, as a Java regex class.
WS_CLASS = (
    r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def squeeze(col: Column) -> Column:
    """Whitespace runs as one space, trimmed."""
    return F.trim(F.regexp_replace(col, WS_CLASS + "+", " "))


def strip(col: Column) -> Column:
    """Trimmed of all whitespace; inner whitespace stays."""
    return F.regexp_replace(col, f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def once(df: DataFrame, key: list[str], keep: list[str]) -> DataFrame:
    """One row for each key, however often it was delivered; a redelivery has the same content.

    Rows whose key is null are dropped: they name no record. The aggregate
    combines map-side, so a key delivered very often costs one row a task.
    """
    return (
        df.where(" and ".join(f"{k} is not null" for k in key))
        .groupBy(*key)
        .agg(*[F.first(c).alias(c) for c in keep])
    )


_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the shared folder of spark.checkpoint.dir; a local one only in local mode where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.gettempdir() + "/wortsee-checkpoints"
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    if not _made:
        atexit.register(release)
    _made.append((spark, path))
    return path


def release() -> None:
    """Delete the folders that cut() has made so far; their tables must no longer be read. Done when the driver ends, at the latest."""
    while _made:
        spark, path = _made.pop()
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: S110 - the session has ended
            pass


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows once to the shared folder and read them from there.

    Unlike localCheckpoint it survives the loss of executors. The schema is
    given when reading, so empty tables and changed nullability are safe. The
    folder stays until release() or the end of the driver.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte offset at which each begins."""
    text = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    return text, np.flatnonzero((data & 0xC0) != 0x80)


def text_buffers(arr) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (length rows + 1, from 0) and bytes of an Arrow string array; null rows are empty."""
    if arr.null_count:
        arr = arr.fill_null("")
    if pa.types.is_large_string(arr.type):
        kind = np.int64
    else:
        kind = np.int32
        if arr.type != pa.string():
            arr = arr.cast(pa.string())
    bufs = arr.buffers()
    if len(arr) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(bufs[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return off - off[0], data


def chunks(off: np.ndarray, most: int):
    """Row ranges of at most about `most` bytes each; a longer row stands alone."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
