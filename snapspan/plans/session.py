"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "snapspan", shuffle: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster passes its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


#: Bytes of a generated method beyond which the JVM keeps it interpreted.
COMPILED = "8000"


#: What the derived tables need of a session that leaves these settings alone.
SETTINGS = {
    # plans whose generated method the JVM would never compile run operator by operator instead
    "spark.sql.codegen.hugeMethodLimit": ("65535", COMPILED),
    # rows that lie together by play already are not shuffled again to be joined on the play and more
    "spark.sql.requireAllClusterKeysForCoPartition": ("true", "false"),
    # Spark 4.1 takes a union of columnar scans for laid out by bucket and does not lay it out so: equal rows then miss each other
    "spark.sql.unionOutputPartitioning": ("true", "false"),
}


def settle(spark: SparkSession) -> None:
    """Apply ``SETTINGS``; what the session sets itself stays."""
    for key, (usual, wanted) in SETTINGS.items():
        if spark.conf.get(key) == usual:
            spark.conf.set(key, wanted)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where it is unset a local session gets a scratch folder, a cluster is refused."""
    known = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(known)
    return known


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: a lost executor re-reads the files, not the whole plan."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
