"""Event logs whose one JSON document is too large for one task.

The text reader cuts a file at every closing brace, so a document is split like any text
file. What a cut means depends on all text before it: whether it lies in a string, how deep it is
nested, under which key of the document, and after how many events. All four are running
values, found in two steps: totals per split, accumulated over the splits of a file (a row each),
and a window inside the split. Quotes that are not escaped are the same whatever came before, so
whether a split begins in a string is the parity of those before it; the nesting a piece adds is
counted for both cases and the right one taken afterwards.

Pieces of one event are then put together and parsed: the largest value is one event.

Defined cases: keys of the document may come in any order and need not be events; values of other
keys may be scalars, lists of scalars, objects, or lists of objects; a log without events gives no rows;
a document that ends early, or an event that is no JSON, fails the read, as does text after the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseweave.runtime import materialise
from caseweave.sources.event_log import LOG_FILE, LOG_SCHEMA, flat_event

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_LIST_END = rf'[^\[\]{{}}"]*+(?:{_STRING}[^\[\]{{}}"]*+)*+\]'
_PLAIN = rf'(?:{_STRING}|[-+.\w]++|\[{_LIST_END})'
#: From the document's start or the end of a list to the next key whose value holds objects.
_NEXT_KEY = (
    rf'(?s)^(?:\s*+\{{|{_LIST_END})?+(?:\s*+,?\s*+{_STRING}\s*+:\s*+{_PLAIN}(?=\s*+,))*+'
    r'\s*+,?\s*+"([^"\\]*+(?:\\.[^"\\]*+)*+)"\s*+:\s*+[\[{]\s*+'
)
_STRING_END = r'(?s)^[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|$)'


def _count(text: Column, kind: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, kind, ""))


def _nesting(parts: Column, odd: int) -> Column:
    """Openings less closings in the parts that are not strings."""
    outside = F.array_join(F.filter(parts, lambda _, i: i % 2 == odd), "")
    return _count(outside, r"[\[{]") - _count(outside, r"[\]}]")


def _before(pieces: DataFrame, **running: Column) -> DataFrame:
    """*pieces* with the sum of each value over the pieces before it in its file."""
    splits = pieces.groupBy("file", "split").agg(*[F.sum(v).alias(n) for n, v in running.items()])
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.select("file", "split", *[
        F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"base_{n}") for n in running
    ])
    inside = Window.partitionBy("file", "split").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.join(bases, ["file", "split"]).select(*pieces.columns, *[
        (F.col(f"base_{n}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(n)
        for n, v in running.items()
    ])


def _key_so_far(pieces: DataFrame) -> DataFrame:
    """*pieces* with ``under``: the last key met up to each."""
    found = F.when(F.col("key").isNotNull(), F.struct("n", "key"))
    splits = pieces.groupBy("file", "split").agg(F.max(found)["key"].alias("last"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.select("file", "split", F.last("last", True).over(earlier).alias("base"))
    inside = Window.partitionBy("file", "split").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return pieces.join(bases, ["file", "split"]).select(
        *pieces.columns, F.coalesce(F.last("key", True).over(inside), "base").alias("under")
    )


def _pieces(spark: SparkSession, paths: str) -> DataFrame:
    """Text up to and with each closing brace: (file, split, n, text, quotes, in_text, in_string)."""
    meta = F.col("_metadata")
    read = spark.read.option("lineSep", "}").text(paths).select(
        meta["file_path"].alias("file"), meta["file_size"].alias("bytes"),
        meta["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("n"),
        F.concat("value", F.lit("}")).alias("text"),
    )
    parts = F.split(F.regexp_replace("text", r"(?s)\\.", ""), '"', -1)
    return read.withColumn("parts", parts).select(
        "file", "bytes", "split", "n", "text", (F.size("parts") - 1).alias("quotes"),
        _nesting(F.col("parts"), 0).alias("in_text"), _nesting(F.col("parts"), 1).alias("in_string"),
    )


def _fails_if_broken(pieces: DataFrame) -> DataFrame:
    """(file) of all files; raises where a document is not closed at its end."""
    step = F.when(F.col("quotes_before") % 2 == 0, F.col("in_text")).otherwise(F.col("in_string"))
    whole = pieces.groupBy("file").agg(
        # a brace was added after the text behind the last one, too
        (F.sum(F.octet_length("text")) - F.max("bytes")).alias("added"),
        F.sum("quotes").alias("quotes"), F.sum(step).alias("nesting"),
        F.max_by("text", "at").alias("end"),
    )
    sound = (
        (F.col("quotes") % 2 == 0) & (F.col("nesting") + F.col("added") == 0)
        & ((F.col("added") == 0) | (F.trim(F.translate("end", "\t\r\n", "")) == "}"))
    )
    told = F.raise_error(F.concat(F.lit("broken event log: "), "file"))
    return whole.select(F.when(sound, F.col("file")).otherwise(told).alias("file"))


def read_events(spark: SparkSession, root: str, name: str = LOG_FILE) -> DataFrame:
    """Rows as of ``event_log.flatten(event_log.read_logs(...))``, of logs of any size.

    A document is read by as many tasks as it has splits (``spark.sql.files.maxPartitionBytes``).
    """
    read = materialise(
        _before(_pieces(spark, f"{root.rstrip('/')}/*/{name}"), quotes_before=F.col("quotes"))
        .withColumn("at", F.struct("split", "n")), "log-pieces",
    )
    sound = _fails_if_broken(read)
    outside = F.col("quotes_before") % 2 == 0
    step = F.when(outside, F.col("in_text")).otherwise(F.col("in_string"))
    deep = _before(read.withColumn("step", step), depth=F.col("step"))
    shallow = F.col("depth") <= 2
    rest = F.when(outside, F.col("text")).otherwise(F.regexp_replace("text", _STRING_END, ""))
    # no key: the list has ended, or what follows are values without objects
    none = F.when((F.col("depth") <= 1) | rest.rlike(rf"(?s)^{_LIST_END}"), F.lit(""))
    met = F.nullif(F.regexp_extract(rest, _NEXT_KEY, 1), F.lit(""))
    key = F.when(shallow, F.coalesce(met, none))
    under = materialise(_key_so_far(deep.withColumn("key", key)), "log-keys")
    of_events = F.col("under") == "events"
    # the brace closes an event: it is no part of a string and leaves the list of events open
    after = (F.col("quotes_before") + F.col("quotes")) % 2 == 0
    closes = after & of_events & (F.col("depth") + F.col("step") == 2)
    placed = _before(
        under.where(of_events).withColumn("closes", F.coalesce(closes, F.lit(False)).cast("int")),
        pos=F.col("closes"),
    )
    begun = F.when(F.col("key").isNotNull(), F.regexp_replace(rest, _NEXT_KEY, ""))
    begun = F.coalesce(begun, F.regexp_replace("text", r"^\s*+,?\s*+", ""))
    inside = placed.select(
        "file", "pos", "at", F.when(shallow, begun).otherwise(F.col("text")).alias("text")
    )
    events = inside.groupBy("file", "pos").agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("all"))
    event_type = LOG_SCHEMA.removeprefix("events array<").removesuffix(">")
    parsed = events.join(sound, "file").select(
        F.url_decode(F.element_at(F.split("file", "/"), -2)).alias("graph_key"),
        F.col("pos").cast("int").alias("pos"),
        F.from_json(F.array_join("all.text", ""), event_type, {"mode": "FAILFAST"}).alias("event"),
    )
    return flat_event(parsed)


def log_names(spark: SparkSession, root: str, name: str = LOG_FILE) -> DataFrame:
    """(graph_key) of every log, also of those without events; reads no content."""
    files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/{name}")
    return files.select(F.url_decode(F.element_at(F.split("path", "/"), -2)).alias("graph_key"))
