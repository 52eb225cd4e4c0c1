"""Session helpers: the settings every job here expects, and the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the operators rely on.  AQE re-plans joins at run time from real
# shuffle sizes (broadcast conversion, skew-join splitting, partition
# coalescing), which is the size check behind every join without an explicit
# hint.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "tessera", **conf) -> SparkSession:
    """Build (or reuse) a session with the defaults above plus ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a folder every executor can reach; it is
    only read here.  Where it is unset (local tests) a fresh folder is made and
    handed to ``setCheckpointDir``.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        d = sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="tessera-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A fresh path below the shared folder (never a machine-local temp dir)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if not parts:
        parts = ("tessera",)
    return "/".join([base, *parts, uuid.uuid4().hex])


__all__ = ["get_spark", "ensure_checkpoint_dir", "shared_path", "ship_package", "DEFAULT_CONF"]


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tessera`` importable by the Python workers of this application.

    Functions run by ``mapInPandas`` / ``applyInPandas`` are pickled by
    reference to their module, so executors need the package.  A zip of it is
    written once per application to the shared folder and added with
    ``addPyFile`` (the same as ``--py-files``).
    """
    import io
    import os as _os
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    root = _os.path.dirname(_os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in _os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = _os.path.join(d, f)
                    z.write(full, _os.path.relpath(full, _os.path.dirname(root)))
    from tessera.sources.fs import write_bytes
    path = shared_path(spark, "pyfiles") + "/tessera.zip"
    write_bytes(path, buf.getvalue())
    sc.addPyFile(path)
    _SHIPPED.add(app)
