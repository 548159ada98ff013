"""Session defaults and the shared workspace for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


# Wide feature rows lead to generated methods of thousands of bytes. The JVM never compiles those above 8000 bytes and often gives up on smaller
# ones, so that they run many times slower the longer a task is; Spark's split, per-operator code does not. Spark's own limit is far higher.
TUNING = {"spark.sql.codegen.hugeMethodLimit": "2000"}


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession) -> SparkSession:
    """Applies runtime settings that suit wide feature rows, unless the session sets them itself."""
    given = dict(spark.sparkContext.getConf().getAll())
    for key, value in TUNING.items():
        if key not in given:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g",
                  app: str = "ledgerlens") -> SparkSession:
    """Single-machine session for tests and benchmarks; on a cluster the submitter configures Spark."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def workspace(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a folder of its own; on a cluster a machine-local
    folder would be lost with its executor, so a missing setting is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="ledgerlens-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/ledgerlens/{spark.sparkContext.applicationId}"


@contextmanager
def _short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of executions inside the block go when they end, not when the driver's JVM happens to collect garbage.

    A session that sets this itself keeps its setting.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    if SHUFFLE_CLEANUP in dict(spark.sparkContext.getConf().getAll()) or before == "true":
        yield
        return
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the workspace and read it back.

    Cuts lineage, survives executor loss, and makes values that depend on the physical layout
    (such as range partition ids) identical for every later reader.
    """
    spark = df.sparkSession
    path = f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    with _short_lived_shuffles(spark):
        df.write.parquet(path)
    if scopes := _scopes.get():
        scopes[-1].append(path)
    stored = spark.read.schema(schema).parquet(path)
    stored.stored_at = path
    return stored


def delete(spark: SparkSession, paths: list[str]) -> None:
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in map(files.Path, paths):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Deletes what ``materialize`` stored for these tables; nothing that is still to be read may depend on them."""
    for table in tables:
        delete(table.sparkSession, [table.stored_at])


#: Open scopes of this thread (or task); each holds the paths that were stored inside it.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what ``materialize`` stored inside the block in this thread when the block ends; write or collect its results before that."""
    own: list[str] = []
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(token)
        delete(spark, own)


@contextmanager
def outside() -> Iterator[None]:
    """What is stored inside the block outlives the scopes around it."""
    token = _scopes.set(())
    try:
        yield
    finally:
        _scopes.reset(token)
