"""Session construction and the runtime settings every job relies on."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings the library needs regardless of who built the session. They are
# runtime SQL confs, so they can be applied to a session we did not create.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    # Small shuffles feed CPU-heavy row work (regex extraction, nested-list
    # functions): do not let AQE merge them below one partition per core.
    # At cluster scale partitions are far above this floor anyway.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128KB",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings (idempotent, cheap)."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "casework", extra_conf: dict[str, str] | None = None) -> SparkSession:
    """Local/test session. On a cluster, use the cluster's builder and call
    :func:`configure` instead."""
    master = master or os.environ.get("CASEWORK_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("CASEWORK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Checkpoint files of intermediates are removed once unreferenced.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in {**RUNTIME_CONF, **(extra_conf or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the session was
    started: it is zipped and added to the application, once."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="casework-"), "casework.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    out.write(file, os.path.relpath(file, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for materialised intermediates and round trips.

    Uses the cluster's ``spark.checkpoint.dir``. Where it is unset, a local
    session (all threads in one process) gets a private folder under the system
    temp dir, registered as the checkpoint dir so ``DataFrame.checkpoint()``
    works too; on a cluster that is an error, since executors could not read
    each other's files.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        # setCheckpointDir appends a random sub-folder; its parent is ours.
        return current.rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
    local = tempfile.mkdtemp(prefix="casework-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir().rstrip("/")


def new_output_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-path of the scratch folder."""
    import uuid

    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
