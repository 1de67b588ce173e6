"""Model responses to predictions, and predictions back onto records."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.functions.text import strip
from caseweave.functions.variants import as_text, field, is_truthy
from caseweave.runtime import materialise
from caseweave.sources.records import Catalog

_FENCE = "```"


def fenced_json(raw: Column) -> Column:
    """The response, or what is between its first two fences, parsed."""
    text = strip(raw)
    inner = F.split_part(text, F.lit(_FENCE), F.lit(2))
    inner = F.when(F.startswith(inner, F.lit("json")), F.substring(inner, 5, 2**31 - 1)).otherwise(inner)
    return F.try_parse_json(
        strip(F.when(F.startswith(text, F.lit(_FENCE)), inner).otherwise(text))
    )


def braced_json(raw: Column) -> Column:
    """Everything from the first ``{`` to the last ``}``, parsed."""
    return F.try_parse_json(F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")))


def normalise(items: Column, catalog: Catalog) -> Column:
    """Catalog spelling of each item; unknown ones drop out, order and repeats stay."""
    allowed = F.from_json(F.lit(json.dumps(catalog.canonical)), "map<string,string>")
    named = F.transform(items, lambda x: F.try_element_at(allowed, F.lower(strip(x))))
    return F.filter(named, lambda x: x.isNotNull() & (x != ""))


def _named_by_join(parsed: DataFrame, entries: DataFrame) -> DataFrame:
    """*parsed* with ``_named``: the items in the spelling of a catalog of any size."""
    # two spellings of one name: the later entry wins
    known = entries.groupBy(F.lower("event_type").alias("_key")).agg(
        F.max_by("event_type", "pos").alias("_name")
    ).where("_name <> ''")
    rows = materialise(
        parsed.withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_json", F.to_json("_json")), "responses",
    )
    items = rows.select("_row", F.posexplode("_items").alias("_i", "_item"))
    named = (
        items.withColumn("_key", F.lower(strip(F.col("_item")))).join(known, "_key")
        .groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_i", "_name")))["_name"].alias("_named"))
    )
    empty = F.array().cast("array<string>")
    return (
        rows.join(named, "_row", "left").withColumn("_json", F.try_parse_json("_json"))
        .withColumn("_named", F.coalesce("_named", empty)).drop("_row")
    )


def parse_responses(
    responses: DataFrame,
    catalog: Catalog | DataFrame,
    agent: bool = False,
    single: bool = False,
    max_activities: int = 0,
) -> DataFrame:
    """Add ``pred``, ``confidence`` and ``error`` to rows with a ``raw`` response.

    An agent's answer may be wrapped in prose and a bad confidence counts as 0;
    otherwise a bad confidence fails the whole answer. A failed answer is an
    empty prediction with confidence 0. A catalog of any size is given as its
    entries (pos, event_type, description); spellings are then found by a join.
    """
    parsed = responses.withColumn("_json", braced_json(F.col("raw")) if agent
                                  else fenced_json(F.col("raw")))
    given, stated = field(F.col("_json"), "activities"), field(F.col("_json"), "confidence")
    kind = F.schema_of_variant(given)
    empty = F.array().cast("array<string>")
    items = (
        F.when(given.isNull(), empty)
        .when(kind == "STRING", F.array(F.try_variant_get(given, "$", "string")))
        .when(kind.startswith("ARRAY"),
              F.transform(F.try_variant_get(given, "$", "array<variant>"), as_text))
    )
    if agent:
        items = F.when(~is_truthy(given), empty).otherwise(items)
    number = F.when(is_truthy(stated), F.coalesce(
        F.try_variant_get(stated, "$", "double"),
        strip(F.try_variant_get(stated, "$", "string")).try_cast("double"),
    )).otherwise(F.lit(0.0))
    if agent:
        number = F.coalesce(number, F.lit(0.0))

    parsed = parsed.withColumn("_items", items).withColumn("_number", number)
    is_object = F.schema_of_variant("_json").startswith("OBJECT")
    error = (
        F.when(F.col("_json").isNull(), "no_json")
        .when(~is_object, "not_an_object")
        .when(F.col("_items").isNull(), "bad_activities")
        .when(F.col("_number").isNull(), "bad_confidence")
    )
    if isinstance(catalog, DataFrame):
        parsed = _named_by_join(parsed, catalog)
        named = F.col("_named")
    else:
        named = normalise(F.col("_items"), catalog)
    if single:
        named = F.slice(named, 1, 1)
    elif max_activities and not agent:
        named = F.slice(named, 1, max_activities)
    return (
        parsed.withColumn("error", error)
        .withColumn("pred", F.when(F.col("error").isNull(), named).otherwise(empty))
        .withColumn("confidence", F.when(F.col("error").isNull(), F.col("_number")).otherwise(F.lit(0.0)))
        .drop("_json", "_items", "_number", "_named")
    )


def failure_rate(predictions: DataFrame) -> DataFrame:
    """One row per kind of error with its share of all responses."""
    return (
        predictions.groupBy(F.coalesce("error", F.lit("ok")).alias("outcome"))
        .agg(F.count("*").alias("n"))
    )


def check_failures(predictions: DataFrame, at_most: float) -> None:
    """Fail when too many responses gave no prediction: that is a broken client."""
    row = predictions.agg(
        F.count("*").alias("n"), F.count("error").alias("failed")
    ).first()
    if row.n and row.failed / row.n > at_most:
        raise ValueError(f"{row.failed} of {row.n} response(s) gave no prediction")


def predictable(records: DataFrame, use_email: bool, use_graph: bool) -> DataFrame:
    """Records a prediction is asked for; an e-mail arm without graph needs an e-mail."""
    return records.where("has_email") if use_email and not use_graph else records


def onto_records(records: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every record with ``pred`` and ``confidence``; empty and 0 when there is none."""
    kept = [c for c in records.columns if c not in ("pred", "confidence")]
    found = predictions.select("record_pos", "pred", "confidence")
    return records.select(*kept).join(found, "record_pos", "left").select(
        *kept,
        F.coalesce("pred", F.array().cast("array<string>")).alias("pred"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )
