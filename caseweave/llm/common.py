"""Column expressions and small plans that several operators share.

White space is always the six characters space and U+0009 to U+000D, so that
words are the runs ``[^\\x20\\x09-\\x0D]+``. Python's ``bytes.split()`` cuts at
the same six, which the operators that work on Arrow batches rely on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseweave.runtime import work_dir

__all__ = [
    "BLANKS", "bind", "delete", "files_dir", "filesystem", "load", "materialise", "new_folder", "release",
    "running_total", "stored", "words_of", "work_dir", "written",
]

BLANKS = " \t\n\v\f\r"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Folders of the tables written here, by application.
_WRITTEN: dict[str, list[str]] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a table below the shared folder, known to :func:`written`."""
    path = f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _written(df: DataFrame, name: str, **options: str) -> DataFrame:
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """*df* written below the shared folder and read again, so that no consumer computes it anew."""
    return _written(df, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """*df* written below the shared folder, compressed by zstd, and read again."""
    return _written(df, name, compression="zstd")


def written(spark: SparkSession) -> list[str]:
    """Folders of the tables that :func:`materialise` and :func:`stored` have written."""
    return list(_WRITTEN.get(spark.sparkContext.applicationId, []))


def release(needed: DataFrame, paths: list[str]) -> list[str]:
    """Delete the tables at *paths* that *needed* does not read; gives the paths that stay."""
    spark = needed.sparkSession
    read = {file.rsplit("/", 2)[-2] for file in needed.inputFiles()}
    stay = [p for p in paths if p.rsplit("/", 1)[-1] in read]
    for path in set(paths) - set(stay):
        delete(spark, path)
    return stay


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table written here."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    known = _WRITTEN[spark.sparkContext.applicationId]
    if path in known:
        known.remove(path)


def files_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder for files that tasks write themselves."""
    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """(file system, path) of a folder; a plain path is a local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (
        fs.LocalFileSystem(), uri
    )


def words_of(text: Column) -> Column:
    """The words of *text* in order; null gives null."""
    return F.array_remove(F.split(text, r"[\t-\r ]+"), "")


def bind(value: Column, body) -> Column:
    """``body(v)`` with *value* computed once, also where *body* uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_total(
    df: DataFrame, group: list[str], order: list[str], value: Column, name: str
) -> DataFrame:
    """*df* with column *name*: the sum of *value* over the rows before this one in its group.

    Rows are range-partitioned by group and order and written once; each
    partition is summed, the sums are accumulated per group (one row per group
    and partition), and a window inside the partition does the rest. So a group
    with a third of all rows is spread over a third of the partitions. Group
    columns must not be null. Rows that tie in all order columns get their
    places in any order.
    """
    keyed = df.withColumn("_value", value.cast("long"))
    if group or order:
        keyed = keyed.repartitionByRange(*group, *[F.col(c).asc_nulls_first() for c in order])
    rows = materialise(keyed.withColumn("_part", F.spark_partition_id()), f"ranged-{name}")
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = (
        rows.groupBy(*group, "_part").agg(F.sum("_value").alias("_sum"))
        .withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .drop("_sum")
    )
    inside = (
        Window.partitionBy(*group, "_part")
        .orderBy(*[F.col(c).asc_nulls_first() for c in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.join(bases, [*group, "_part"])
        .withColumn(name, F.col("_base") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .drop("_base", "_part", "_value")
    )
