"""Session helpers for tests, the bench and scripts.

Library code never builds its own session; it takes the caller's.
``local_session`` builds a local one with test/bench settings.
``ensure_checkpoint_dir`` only sets a checkpoint folder where none is
configured (local runs), so a cluster's own ``spark.checkpoint.dir`` wins.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

#: Bytes of stored input for each shuffle partition of a load, whose shuffles are three to five times that,
#: and bytes shuffled or read that a task of a load aims at; in memory they are up to some twenty times as many.
LOAD_PARTITION_BYTES, LOAD_TASK_BYTES = 4 << 20, 16 << 20

_SIZING = threading.RLock()  # a load must not restore what another has set

LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.host": "127.0.0.1",
    "spark.driver.bindAddress": "127.0.0.1",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Local disk: list partition folders on the driver instead of launching a
    # listing job per table (clusters keep their own threshold).
    "spark.sql.sources.parallelPartitionDiscovery.threshold": "1024",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "pdcspark",
                  extra: dict | None = None) -> SparkSession:
    """A local session with test-friendly settings (UI off, UTC, AQE on)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(LOCAL_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("PDCSPARK_DRIVER_MEMORY", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names, if any."""
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    return spark.conf.get("spark.checkpoint.dir", None)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the session's checkpoint dir; only set a scratch one where unset (tests)."""
    d = checkpoint_dir(spark)
    if d:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(d)
        return spark.sparkContext.getCheckpointDir() or d
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    d = tempfile.mkdtemp(prefix="pdcspark-ckpt-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


def storage_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a scratch one in local mode where it is unset (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return (shared or ensure_checkpoint_dir(spark)).rstrip("/")


def stored_bytes(spark: SparkSession, paths: Iterable[str]) -> int:
    """Bytes of files, or of folders with all that is in them."""
    conf, path_of = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sum(path.getFileSystem(conf).getContentSummary(path).getLength() for path in map(path_of, paths))


@contextlib.contextmanager
def sized_shuffles(spark: SparkSession, input_bytes: int) -> Iterator[None]:
    """Jobs within have shuffle partitions by the size of what they read, at least as many as the session has.

    A task's share then stays the same as the data grows, and its sorts stay in
    memory; AQE merges what is small and splits what is hot, up to a size that
    fits beside other tasks.  What a task reads of files is bounded in the same
    way, since aggregates keep a map of it.  The session's own settings are put back.
    """
    partitions = "spark.sql.shuffle.partitions"
    shares = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    as_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    with _SIZING:
        own = {key: spark.conf.get(key) for key in (partitions, *shares)}
        spark.conf.set(partitions, str(max(int(own[partitions]), input_bytes // LOAD_PARTITION_BYTES)))
        for share in shares:
            spark.conf.set(share, str(min(as_bytes(own[share]), LOAD_TASK_BYTES)))
        try:
            yield
        finally:
            for key, value in own.items():
                spark.conf.set(key, value)
