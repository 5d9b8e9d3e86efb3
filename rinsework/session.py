"""Session defaults and staged tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Collection
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from threading import Lock
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Applications whose executors have the package.
_shipped: set[str] = set()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use.

    On a cluster the session comes from ``spark-submit``; nothing below is needed there apart from
    adaptive execution (on by default) and a shared ``spark.checkpoint.dir``.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rinsework")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder, because there the driver's disk is
    every executor's disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    set_on_context = spark.sparkContext.getCheckpointDir()
    if set_on_context:
        return set_on_context.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="rinsework-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application.

    Functions that run in Python on executors import the package there. Where executors can't see the driver's
    folder (or the driver runs in another one), they need a copy; Spark's own file distribution takes it there.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="rinsework-")) / "rinsework.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, Path(package.name) / source.relative_to(package))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def concurrently(*tasks: Callable[[], Any]) -> list[Any]:
    """Run independent Spark jobs side by side and return their results in order."""
    with ThreadPoolExecutor(max_workers=len(tasks)) as pool:
        return [f.result() for f in [pool.submit(t) for t in tasks]]


class Staging:
    """Writes intermediate tables to the shared folder and reads them back.

    A staged table cuts the lineage, survives the loss of any executor, and — unlike a checkpoint of
    rows — is columnar, so later passes read only the columns they use.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{staging_root(spark)}/stage-{uuid.uuid4().hex}"
        self._written: dict[str, str] = {}
        self._lock = Lock()

    def write(self, df: DataFrame, name: str) -> DataFrame:
        with self._lock:
            path = f"{self.folder}/{len(self._written):03d}-{name}"
            self._written[path] = name
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_counted(self, df: DataFrame, name: str, **wanted: Column) -> tuple[DataFrame, dict[str, int]]:
        """Write a table and return it with aggregates of its rows, ``rows`` among them, taken by the same pass.

        The aggregates sit right before the write, in the stage whose tasks count once however often they are tried.
        """
        observed = Observation()
        counts = {"rows": F.count(F.lit(1)), **wanted}
        written = self.write(df.observe(observed, *[c.alias(f"c{i}") for i, c in enumerate(counts.values())]), name)
        found = observed.get
        return written, {n: found.get(f"c{i}", 0) or 0 for i, n in enumerate(counts)}

    def discard(self, keep: Collection[str] = ()) -> None:
        """Delete this object's own tables, except those of the given names, once nothing reads them."""
        jvm = self.spark._jvm
        for path, name in self._written.items():
            if name not in keep:
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
