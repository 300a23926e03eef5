"""Session builder and table access shared by every query."""

from __future__ import annotations

import io
import os
import pathlib
import zipfile

from pyspark.sql import DataFrame, SparkSession

from mensura.staging import place, reached

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def build(app: str = "mensura", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine expects (AQE, ANSI, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("MENSURA_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return reachable(spark)


_shipped: set[str] = set()


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package even when only the driver's sys.path has it: by path on
    this machine, and on a cluster by an archive in the shared folder, which executors fetch."""
    sc = spark.sparkContext
    env = sc.environment
    if REPO not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (REPO, env.get("PYTHONPATH", "")) if x)
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared and not sc.master.startswith("local") and sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        path = place(spark, "mensura.zip")
        store, target = reached(spark, path)
        out = store.create(target)
        out.write(bytearray(_archive()))
        out.close()
        sc.addPyFile(path)
    return spark


def _archive() -> bytes:
    """The package's modules as a zip file."""
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(pathlib.Path(REPO, "mensura").rglob("*.py")):
            z.write(p, p.relative_to(REPO).as_posix())
    return raw.getvalue()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
