"""Session helpers: where intermediate tables go, how they are written and when they are deleted."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, folder: str | None = None
) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own. *folder* is for intermediate tables."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("caseweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
        # beyond this size the JVM does not compile a generated method, and the
        # split-up evaluation of long projections is several times faster
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if folder:
        builder = builder.config("spark.checkpoint.dir", folder)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: How intermediate tables are packed: half the size of the default for little more time.
CODEC = "zstd"
#: Bytes of a method beyond which the JVM does not compile it.
COMPILED_BYTES = 8000


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset the
    warehouse is used, which all executors can reach as well.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/caseweave-intermediate"


#: Folders written by each open work area, innermost last.
_AREAS: list[list[str]] = []


def written_path(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table, known to the open work area."""
    path = f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _AREAS:
        _AREAS[-1].append(path)
    return path


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """Keep generated methods to a size that the JVM compiles, while a table is written inside.

    Larger ones are interpreted, and long projections in them take several times as long as
    split up. The session's value is put back afterwards.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), COMPILED_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write *df* once to the shared folder and read it back.

    Used where a table feeds several consumers, so that none of them recomputes
    it and a lost executor costs a re-read only. Parquet keeps column pruning
    and gives the planner real sizes to choose joins by.
    """
    spark = df.sparkSession
    path = written_path(spark, name)
    with compiled_methods(spark):
        df.write.option("compression", CODEC).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


@contextmanager
def work_area(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables written inside, once their results have been used.

    Meant around building a query and using its result, by the thread that does
    both: ``with work_area(spark): query(...).write.parquet(...)``.
    """
    known = {t.name for t in spark.catalog.listTables()}
    _AREAS.append([])
    try:
        yield
    finally:
        for table in {t.name for t in spark.catalog.listTables()} - known:
            if table.startswith("links_"):
                forget_table(spark, table)
        for path in _AREAS.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
