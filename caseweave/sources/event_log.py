"""Object-centric event logs, one JSON document per case folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed value: file name of a case's observed log
LOG_FILE = "filled_ocel.json"

LOG_SCHEMA = (
    "events array<struct<type: string, time: string, "
    "attributes: array<struct<name: string, value: string>>, "
    "relationships: array<struct<objectId: string>>>>"
)


def read_logs(spark: SparkSession, root: str) -> DataFrame:
    """(graph_key, events) for every ``<root>/<graph_key>/filled_ocel.json``.

    A folder name is the key. A broken document fails the read.
    """
    path = F.col("_metadata.file_path")
    return (
        spark.read.schema(LOG_SCHEMA)
        .option("multiLine", True).option("mode", "FAILFAST")
        .json(f"{root.rstrip('/')}/*/{LOG_FILE}")
        .select(
            F.url_decode(F.element_at(F.split(path, "/"), -2)).alias("graph_key"), "events"
        )
    )


def parse_logs(documents: DataFrame) -> DataFrame:
    """Same result from (graph_key, document) rows holding the JSON text."""
    return documents.select(
        "graph_key",
        F.from_json("document", LOG_SCHEMA, {"mode": "FAILFAST"})["events"].alias("events"),
    )


def flatten(logs: DataFrame) -> DataFrame:
    """One row per event: (graph_key, pos, type, time, attributes, object_ids)."""
    return flat_event(logs.select("graph_key", F.posexplode("events").alias("pos", "event")))


def flat_event(events: DataFrame) -> DataFrame:
    """The fields of column ``event`` with what stands for a missing one."""
    objects = F.transform("event.relationships", lambda r: r["objectId"])
    return events.select(
        "graph_key", "pos",
        F.coalesce("event.type", F.lit("?")).alias("type"),
        F.coalesce("event.time", F.lit("")).alias("time"),
        F.col("event.attributes").alias("attributes"),
        F.filter(F.coalesce(objects, F.array().cast("array<string>")),
                 lambda o: o.isNotNull() & (o != "")).alias("object_ids"),
    )
