"""SparkSession construction with the settings the operators assume."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session should carry: UTC so naive timestamps round-trip,
# AQE so shuffle partition counts, skewed joins and broadcast conversion
# are decided from runtime statistics instead of guesses.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def _default_driver_memory() -> str:
    """60% of the machine's memory, at most 16 GB (local mode runs the
    executors inside the driver JVM)."""
    try:
        with open("/proc/meminfo") as f:
            kb = int(next(line for line in f if line.startswith("MemTotal")).split()[1])
        return f"{max(1, min(16, int(kb * 0.6 / 1024 / 1024)))}g"
    except (OSError, StopIteration, ValueError):
        return "4g"


def build_session(
    master: str | None = None,
    app_name: str = "lakeloom",
    shuffle_partitions: int | None = None,
    driver_memory: str | None = None,
    extra_conf: dict | None = None,
) -> SparkSession:
    """Create (or reuse) a session.

    ``master`` defaults to ``local[N]`` with N from ``BENCH_CPUS`` or 8.  On a
    cluster pass the cluster's master (or leave the builder's) and a
    shuffle-partition count sized so each partition stays ~128-256 MB.
    A checkpoint directory is only set when the cluster did not name one.
    """
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    conf["spark.driver.memory"] = driver_memory or _default_driver_memory()
    conf.update(extra_conf or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``lakeloom`` importable in the Python workers (pandas UDFs and
    ``mapInPandas`` unpickle functions by module reference): zip the package
    once and ``addPyFile`` it, as ``--py-files`` would on a cluster."""
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_lakeloom_shipped", False):
        return
    import lakeloom

    pkg_dir = os.path.dirname(os.path.abspath(lakeloom.__file__))
    root = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="lakeloom-pkg-"), "lakeloom.zip")
    with zipfile.ZipFile(zpath, "w") as z:
        for base, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    sc._lakeloom_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory, setting a scratch one only
    when none is configured (local runs and tests).  On a cluster the shared
    folder named in ``spark.checkpoint.dir`` is used as-is."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not conf_dir:
        conf_dir = tempfile.mkdtemp(prefix="lakeloom-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir
