"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "consigna", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are written for."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors can reach: under spark.checkpoint.dir, else the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.staged"
        if base.startswith(("file:", "/")) and not (spark.conf.get("spark.master", "") or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share; the warehouse is a local folder")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written to a new shared folder and read again: cuts lineage, survives lost executors."""
    folder = shared_folder(df.sparkSession, name)
    df.write.options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def emptied(spark: SparkSession, folder: str) -> None:
    """Give back the disk of a staged table that no frame reads any more."""
    spark.range(0).write.mode("overwrite").parquet(folder)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Writes in this block remove their shuffle files when they end, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once for each application, as --py-files would."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    home = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp()) / "consigna-package.zip"  # the driver's own; Spark sends it on
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((home / "consigna").rglob("*.py")):
            z.write(f, f.relative_to(home))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(spark.sparkContext.applicationId)
