"""Tables that change while they are read: label upserts and snapshot reloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Last write per key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("_r")).select(key, "_r.*")


def _versions(spark: SparkSession, root: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    out = []
    for s in fs.listStatus(path):
        name = s.getPath().getName()
        done = fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/_SUCCESS"))
        if name.startswith("v") and name[1:].isdigit() and done:
            out.append(int(name[1:]))
    return sorted(out)


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest finished version; an unfinished or failed one is never seen."""
    v = _versions(spark, root)
    return spark.read.parquet(f"{root}/v{v[-1]}") if v else None


def publish(df: DataFrame, root: str, view: str | None = None) -> int:
    """Write the next version whole, then point the view at it. A failed write leaves the old one."""
    spark = df.sparkSession
    v = _versions(spark, root)
    n = (v[-1] if v else 0) + 1
    df.write.mode("overwrite").parquet(f"{root}/v{n}")
    if view:
        spark.read.parquet(f"{root}/v{n}").createOrReplaceTempView(view)
    return n


def label_writer(root: str, key: str = "key", at: str = "at"):
    """``foreachBatch`` function: merge a batch of labels into the store, last write wins.

    The batch number is kept as the version, so a replayed batch rewrites its own version.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        older = [v for v in _versions(spark, root) if v <= batch_id]
        merged = batch
        if older:
            merged = spark.read.parquet(f"{root}/v{older[-1]}").unionByName(batch)
        latest(merged, key, at).write.mode("overwrite").parquet(f"{root}/v{batch_id + 1}")

    return write
