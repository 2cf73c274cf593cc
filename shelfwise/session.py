"""Session construction and shared-storage helpers."""

from __future__ import annotations

import gc
import os
import tempfile
import threading
import time
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

from pyspark.sql import SparkSession

# Settings every job here relies on. On a cluster, pass them with --conf;
# `get_session` only fills in what the caller left unset.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The all-pairs scorer's rows can be long; bound each Arrow batch by bytes.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    # Streaming state (one row per user, book, event type) can outgrow memory.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Checkpoint files go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "shelfwise") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Sends this package's modules to the Python workers, once for each context.

    Not needed where the package is installed on the executors or given with
    ``--py-files``. The archive is the driver's own copy; Spark serves it.
    """
    sc = spark.sparkContext
    if getattr(sc, "_shelfwise_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="shelfwise-")) / "shelfwise.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._shelfwise_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting must point at shared storage; we only invent a
    scratch folder when it is unset (local runs and tests).
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


@contextmanager
def disk_freed(spark: SparkSession, every: float = 20.0, last: float = 1.5) -> Iterator[None]:
    """While the block runs and once after it, lets Spark's cleaner drop shuffle files, checkpoints and cached blocks that nothing refers to.

    The cleaner hears of them when the driver collects garbage, which a driver
    with little to do may not do for half an hour, while executors' disks fill.
    """
    over = threading.Event()

    def collect() -> None:
        with suppress(Exception):  # the session may have ended
            spark.sparkContext._jvm.System.gc()

    def run() -> None:
        while not over.wait(every):
            collect()
        time.sleep(last)  # Py4J tells the JVM once a second which objects Python has dropped
        collect()

    threading.Thread(target=run, daemon=True).start()
    try:
        yield
    finally:
        gc.collect()
        over.set()
