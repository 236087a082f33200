"""Session and checkpoint-directory helpers."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "panelspark", master: str | None = None,
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings this library relies on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    """One JVM holds driver and tasks (a ``local-cluster`` master does not count)."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must come from the session (a shared file system).
    Only a local session without one gets a private temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir is not set; point it to a shared folder")
        current = tempfile.mkdtemp(prefix="panelspark-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors, unlike a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(stats: DataFrame, most: int = 100_000) -> DataFrame:
    """A per-group table, marked for broadcast once its row count is known to be small.

    Eager: the table is computed and checkpointed when this is called (so that it is
    counted and joined without being computed twice), also where the caller builds a plan. Beyond ``most`` rows the hint is left out and the join
    shuffles as usual.
    """
    kept = cut_lineage(stats)
    return F.broadcast(kept) if kept.count() <= most else kept


TASK_BYTES = 8 << 20                  # compressed bytes that a task of a bounded build reads


@contextlib.contextmanager
def bounded_tasks(spark: SparkSession, input_bytes: int):
    """Jobs started inside get more tasks as their input grows, not larger ones.

    Sorts and hash tables of a task hold its whole share of a shuffle, several times the compressed bytes. So scans
    are split and shuffle partitions merged at ``TASK_BYTES``, with enough partitions before the merge.
    """
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ours = {"spark.sql.shuffle.partitions": max(least, 4 * input_bytes // TASK_BYTES),
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_BYTES,
            "spark.sql.files.maxPartitionBytes": TASK_BYTES}
    before = {k: spark.conf.get(k) for k in ours}
    try:
        for k, v in ours.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def listing(spark: SparkSession, path: str) -> tuple:
    """(name, bytes, modification time) of a table's files, through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))
