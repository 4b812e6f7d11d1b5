"""Session factory and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession

_OWN_DIRS: dict[str, str] = {}
_OPEN: dict[str, list] = {}

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@atexit.register
def _drop_own_dirs() -> None:
    for folder in _OWN_DIRS.values():
        shutil.rmtree(folder, ignore_errors=True)


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(master)
        .appName("lumenfold")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets one temporary
    folder of its own. A cluster session without it is refused, since a
    machine-local folder would not survive the loss of an executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="lumenfold-")
    return "file://" + _OWN_DIRS[app]


def sweep(spark: SparkSession) -> None:
    """Deletes every scratch table of this application; results that read them must be written before."""
    for scratch in _OPEN.pop(spark.sparkContext.applicationId, []):
        scratch.close()


class Scratch:
    """Tables written to the shared folder to cut lineage.

    ``keep`` writes a DataFrame once and returns a reader of the written table, so
    that a lost executor costs a re-read, never a recomputation of the loop.
    ``drop`` deletes a table that nothing needs any more. ``free_shuffles``: what
    writing a table shuffled is removed once the table is there, not when the driver
    happens to collect its garbage (Spark 4.1 or later).
    """

    def __init__(self, spark: SparkSession, label: str, free_shuffles: bool = False):
        self.spark = spark
        self.free_shuffles = free_shuffles
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        _OPEN.setdefault(spark.sparkContext.applicationId, []).append(self)
        self._count = 0
        self._paths: dict[int, str] = {}

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.root}/{self._count:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        before = self.spark.conf.get(FREE_SHUFFLES, None)
        if self.free_shuffles:
            self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.parquet(path)
        finally:
            if self.free_shuffles:
                self.spark.conf.unset(FREE_SHUFFLES) if before is None else self.spark.conf.set(FREE_SHUFFLES, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for df in tables:
            path = self._paths.pop(id(df), None) if df is not None else None
            if path:
                self._delete(path)

    def close(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        if path.startswith("file://"):
            shutil.rmtree(path[len("file://") :], ignore_errors=True)
            return
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observed(df: DataFrame, name: str, **measures) -> tuple[DataFrame, Observation]:
    """``df`` with named measures (aggregate columns) that are taken while it is written, and where they can be read.

    The measures cost no pass of their own; ``Observation.get`` waits for the first action.
    """
    seen = Observation(name)
    return df.observe(seen, *(column.alias(key) for key, column in measures.items())), seen
