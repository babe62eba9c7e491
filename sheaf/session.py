"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "sheaf") -> SparkSession:
    """Session used by tests and the bench. A cluster job gets its session from the launcher."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_CHECKPOINT_SET: set[str] = set()


def app_id(spark: SparkSession) -> str:
    """The application id (classic sessions), or the session's configured id (remote sessions)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - a remote session has no local SparkContext
        return spark.conf.get("spark.app.id", None) or f"session-{id(spark)}"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the launcher sets it to a shared file system. Only a single-machine session
    (master ``local`` or ``local[...]``) gets a temporary folder when it is unset; any other raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="sheaf-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    app = app_id(spark)
    if app not in _CHECKPOINT_SET:  # DataFrame.checkpoint() needs it on the context; set it once
        try:
            spark.sparkContext.setCheckpointDir(path)
        except Exception:  # noqa: BLE001 - remote sessions take it from the server configuration
            pass
        _CHECKPOINT_SET.add(app)
    return path


_SCOPES = threading.local()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written intermediates, deleted when the session ends
    (or with the ``scratch_scope`` it was made in)."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if scopes := getattr(_SCOPES, "open", None):
        scopes[-1].append(path)
    try:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    except Exception:  # noqa: BLE001 - a remote session has no JVM handle; its server cleans up
        pass
    return path


def delete_scratch(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``scratch_path`` whose rows are not read again."""
    try:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # noqa: BLE001 - a remote session has no JVM handle; its server cleans up
        pass


@contextmanager
def scratch_scope(spark: SparkSession):
    """Intermediates that this thread writes inside are deleted on leaving: nothing made from them may be read later."""
    if not hasattr(_SCOPES, "open"):
        _SCOPES.open = []
    _SCOPES.open.append([])
    try:
        yield
    finally:
        for path in _SCOPES.open.pop():
            delete_scratch(spark, path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting that holds inside (and in streams started there)."""
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def shuffles_freed(spark: SparkSession):
    """The shuffle files of each job run inside are removed when it ends, not when the driver next collects garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def written(spark: SparkSession, df, name: str):
    """Write ``df`` once to the shared folder and read it back: lineage is cut and the planner knows the size.

    A list of tables with one schema is written one after the other, into one table.
    """
    path = scratch_path(spark, name)
    for part in (parts := df if isinstance(df, list) else [df]):
        part.write.mode("append").parquet(path)
    return spark.read.schema(parts[0].schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sheaf`` importable in Python workers (needed by the pandas UDF paths).

    Zips the package on the driver once per application and registers it with
    ``addPyFile``, which ships it to every executor.
    """
    import zipfile

    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote session: the package must be installed on the cluster
        return
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    zpath = os.path.join(tempfile.mkdtemp(prefix="sheaf-pyfiles-"), "sheaf.zip")  # addPyFile sends it to the executors
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith((".py", ".json")):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)
