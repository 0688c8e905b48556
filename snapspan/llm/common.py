"""What the operators share: reading, the shared folder, tables written there, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

#: Stretches of a text: code points, the end exclusive.
SPANS = ArrayType(StructType().add("kind", StringType()).add("start", IntegerType()).add("end", IntegerType()))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Unset, a local session gets a scratch folder; a cluster is refused."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    known = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(known)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet in the shared folder and read back: the plan before it is not run again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sample_texts(docs: DataFrame, text: str, most: int) -> DataFrame:
    """(h, text): the ``most`` distinct texts with the least hashes, or all, where they lie: only their hashes reach the driver."""
    h = F.xxhash64(F.col(text))
    least = docs.select(h.alias("h")).distinct().orderBy("h").limit(most).collect()
    bound = max((r["h"] for r in least), default=0)
    return docs.select(h.alias("h"), F.col(text).alias("text")).filter(F.col("h") <= bound).dropDuplicates(["h"])


def utf8_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one array, and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset).copy()
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 500_000, rows: int = 1000):
    """Consecutive row ranges of at most ``limit`` bytes and ``rows`` rows, at least one row each. After the last, unused memory is given back."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n, at + rows)
        yield at, to
        at = to
    pa.default_memory_pool().release_unused()


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order of the array."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
