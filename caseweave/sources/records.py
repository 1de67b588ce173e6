"""Hidden e-mail records, the activity catalog, and result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.functions.variants import as_text, field, is_truthy

# More entries than this is not a list of activity classes.
MAX_CATALOG = 10_000


def resolve_input(spark: SparkSession, folder: str, name: str) -> str:
    """``<folder>/<name>.jsonl``, else the first ``<name>*.jsonl``, else an error."""
    return _first_match(spark, folder, [f"{name}.jsonl", f"{name}*.jsonl"])


def resolve_graph(spark: SparkSession, folder: str) -> str:
    return _first_match(spark, folder, ["graph.json", "*.json"])


def resolve_catalog(spark: SparkSession, folder: str, name: str) -> str:
    return _first_match(spark, folder, [
        f"schema_{name}_only.json", f"schema_{name}*.json", "schema_*_only.json", "schema_*.json",
    ])


def _first_match(spark: SparkSession, folder: str, patterns: list[str]) -> str:
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for pattern in patterns:
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, pattern)) or []
        paths = sorted(str(status.getPath()) for status in found)
        if paths:
            return paths[0]
    raise FileNotFoundError(f"none of {', '.join(patterns)} in {folder}")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines in file order; the order key needs no shuffle."""
    return (
        spark.read.text(path)
        .select(
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("line"),
            ).alias("record_pos"),
            F.col("value").alias("line"),
        )
        .where(F.trim("line") != "")
    )


def _strings(value: Column) -> Column:
    return F.transform(F.try_variant_get(value, "$", "array<variant>"), as_text)


def parse_records(lines: DataFrame) -> DataFrame:
    """Typed records from (record_pos, line). A malformed line is an error.

    ``declared_size`` is ``gram_size`` whenever that key is present, even when
    it is null or 0, and ``size`` only without it.
    """
    items = lines.select("record_pos", F.parse_json("line").alias("item"))
    item = F.col("item")

    def text(name: str) -> Column:
        return as_text(field(item, name))

    def number(name: str, kind: str) -> Column:
        return F.try_variant_get(item, f"$.{name}", kind)

    return items.select(
        "record_pos", "item",
        text("case_id").alias("case_id"),
        text("graph_key").alias("graph_key"),
        text("email_uid").alias("email_uid"),
        text("unit_id").alias("unit_id"),
        is_truthy(field(item, "email")).alias("has_email"),
        F.struct(*[
            text(f"email.{name}").alias(name) for name in ("subject", "body", "sender", "objects")
        ]).alias("email"),
        text("observed_timeline").alias("observed_timeline"),
        _strings(field(item, "true_members")).alias("true_members"),
        _strings(field(item, "pred")).alias("pred"),
        number("confidence", "double").alias("confidence"),
        F.when(field(item, "gram_size").isNotNull(), number("gram_size", "long"))
        .otherwise(number("size", "long")).alias("declared_size"),
    )


def echo_lines(records: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every record as JSON with its prediction set: (record_pos, line).

    All original fields are kept; records without a prediction get an empty one.
    """
    empty = F.array().cast("array<string>")
    own = F.map_filter(
        F.variant_get("item", "$", "map<string,variant>"),
        lambda key, _: ~key.isin("pred", "confidence"),
    )
    added = F.map_from_arrays(
        F.array(F.lit("pred"), F.lit("confidence")),
        F.array(
            F.to_variant_object(F.coalesce("p.pred", empty)),
            F.coalesce("p.confidence", F.lit(0.0)).cast("variant"),
        ),
    )
    return records.alias("r").join(predictions.alias("p"), "record_pos", "left").select(
        "record_pos", F.to_json(F.map_concat(own, added)).alias("line")
    )


def write_lines(lines: DataFrame, path: str, order: str = "record_pos") -> None:
    """JSON lines in record order; the sort is spread over range partitions."""
    lines.orderBy(order).select("line").write.text(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(pos, event_type, description) of a JSON array file."""
    return parse_catalog(spark.read.text(path, wholetext=True))


def parse_catalog(documents: DataFrame) -> DataFrame:
    """(pos, event_type, description) of JSON arrays in column ``value``."""
    entries = documents.select(
        F.from_json(
            "value", "array<struct<event_type: string, description: string>>",
            {"mode": "FAILFAST"},
        ).alias("entries")
    )
    return entries.select(F.posexplode("entries").alias("pos", "entry")).select("pos", "entry.*")


class Catalog:
    """Activity classes: the text shown in prompts and the accepted spellings.

    A few dozen rows by nature, and checked: read once and used as constants. Prompts and
    predictions take the entries themselves as well, which may be any number.
    """

    def __init__(self, entries: DataFrame):
        rows = entries.orderBy("pos").limit(MAX_CATALOG + 1).collect()
        if len(rows) > MAX_CATALOG:
            raise ValueError(f"more than {MAX_CATALOG} catalog entries")
        self.text = "\n".join(f"- {r.event_type}: {r.description}" for r in rows)
        # two spellings of one name: the later entry wins
        self.canonical = {r.event_type.lower(): r.event_type for r in rows}


def catalog_text(catalog: Catalog | DataFrame) -> Column:
    """The catalog as prompts show it: a constant, or a subquery over its entries."""
    if not isinstance(catalog, DataFrame):
        return F.lit(catalog.text)
    line = F.concat("event_type", F.lit(": "), "description")
    shown = catalog.agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("all"))
    return shown.select(
        F.array_join(F.transform("all.line", lambda x: F.concat(F.lit("- "), x)), "\n")
    ).scalar()
