"""Session construction for local runs; on a cluster the caller's session is used as it is."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", app: str = "punctual", **conf: str) -> SparkSession:
    n = str(cores)
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(os.cpu_count() or 8) if n == "*" else n)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PUNCTUAL_DRIVER_MEMORY", "12g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach (``spark.checkpoint.dir``). A local temporary folder is
    used only when the setting is absent and the session runs in local mode, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the whole cluster")
    return _local_folder()


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, a write's shuffle files go when it has ended, not when the driver happens to collect its garbage: for
    steps that are written one after the other, each read back from storage by the next."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once a session: functions that run there import it by name."""
    if spark.conf.get("punctual.shipped", None):
        return
    root = Path(__file__).resolve().parent
    # the driver serves this file to executors for as long as the session lives
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='punctual-')}/punctual", "zip", root.parent, root.name)
    spark.sparkContext.addPyFile(archive)
    spark.conf.set("punctual.shipped", "yes")


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="punctual-")
