"""A case's event log as chronological text that cannot show the answer.

Lines are written from named fields only, so attributes that carry the hidden
activities never reach the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.fixed import EMAIL_ACTIVITY, REDACTED
from caseweave.operators.numbering import number_rows, text_parts, whole_text
from caseweave.runtime import materialise


def attribute(attributes: Column, name: str) -> Column:
    """Value of the first attribute of that name."""
    return F.try_element_at(F.filter(attributes, lambda a: a["name"] == name), F.lit(1))["value"]


def event_line(use_email: bool, email_activity: str = EMAIL_ACTIVITY) -> Column:
    """Text of one event; the hidden e-mail's takes several lines."""
    objects = F.array_join("object_ids", ", ")
    has_objects = F.size("object_ids") > 0
    plain = F.concat(
        F.lit("- "), F.col("time"), F.lit(" | "), F.col("type"),
        F.when(has_objects, F.concat(F.lit(" [objects: "), objects, F.lit("]"))).otherwise(""),
    )

    def shown(name: str) -> Column:
        value = attribute(F.col("attributes"), name) if use_email else F.lit(REDACTED)
        return F.concat(F.lit(f"  {name}: "), F.coalesce(value, F.lit("")))

    def meta(prefix: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(prefix), value))

    facts = F.concat_ws(
        " | ",
        meta("EmailID=", attribute(F.col("attributes"), "EmailID")),
        meta("Sender=", attribute(F.col("attributes"), "Sender")),
        F.when(has_objects, F.concat(F.lit("objects: "), objects)),
    )
    email = F.concat_ws(
        "\n",
        F.concat(F.lit("- "), F.col("time"),
                 F.lit(f" | {email_activity} (HIDDEN activities are here)")),
        F.when(facts != "", F.concat(F.lit("  "), facts)),
        shown("Subject"), shown("Body"),
    )
    return F.when(F.col("type") == email_activity, email).otherwise(plain)


def timeline_lines(
    events: DataFrame, use_email: bool, email_activity: str = EMAIL_ACTIVITY
) -> DataFrame:
    """(graph_key, n, line), by time string and file position."""
    lines = events.select(
        "graph_key", "time", "pos", event_line(use_email, email_activity).alias("line")
    )
    numbered = number_rows(materialise(lines, "timeline"), ["graph_key"], ["time", "pos"])
    return numbered.select("graph_key", "n", "line")


def timeline_texts(logs: DataFrame, lines: DataFrame) -> DataFrame:
    """Whole timeline of every log, also of logs without events."""
    texts = whole_text(text_parts(lines, ["graph_key"], []), ["graph_key"], [])
    return logs.select("graph_key").join(texts, "graph_key", "left").select(
        "graph_key",
        F.when(F.col("n_parts").isNull(), "(no events)").otherwise(F.col("text")).alias("body"),
    )


def log_keys(records: DataFrame) -> DataFrame:
    """Ids a log answers to: (application_id, graph_key).

    A case id leads to the graph key of its first record; a graph key to itself.
    """
    known = records.where("coalesce(graph_key, '') <> ''")
    by_case = (
        known.where("coalesce(case_id, '') <> ''")
        .groupBy(F.col("case_id").alias("application_id"))
        .agg(F.min_by("graph_key", "record_pos").alias("graph_key"))
    )
    by_key = (
        known.select(F.col("graph_key").alias("application_id"), "graph_key").distinct()
        .join(by_case, "application_id", "left_anti")
    )
    return by_case.unionByName(by_key)


def answer(requests: DataFrame, keys: DataFrame, texts: DataFrame) -> DataFrame:
    """Timeline per request with ``ok``, ``unknown_id`` or ``missing_file``."""
    found = requests.join(keys, "application_id", "left").join(texts, "graph_key", "left")
    status = (
        F.when(F.col("graph_key").isNull(), "unknown_id")
        .when(F.col("body").isNull(), "missing_file")
        .otherwise("ok")
    )
    # fixed value: the head lines of an answer
    head = F.concat(
        F.lit("Observed event log of application "), F.col("application_id"),
        F.lit(f" (hidden activities are behind the {EMAIL_ACTIVITY} event):"
              "\nEvents (chronological):\n"),
    )
    return found.select(
        *requests.columns, status.alias("status"), F.concat(head, "body").alias("text")
    )
