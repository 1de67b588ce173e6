"""The standard test tables read as the domain tables the jobs work on.

Only what a data loader would do: renaming, grouping into runs, spelling ids.
Every row of a source table takes part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.sources.records import Catalog


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dated(events: DataFrame) -> DataFrame:
    return events.select(
        "user_id",
        F.date_format("ts", "yyyyMMdd").alias("day"),
        "event_id", "event_type", "value",
    )


def occurrence_id(user: Column, day: Column) -> Column:
    return F.concat(F.lit("application_"), user, F.lit("__"), day)


def _guesses(e: Column) -> Column:
    """What a careless predictor makes of one event: drops, swaps, repeats, delays."""
    value, event_id = e["value"], e["event_id"]

    def guess(order: Column, sub: int, token: Column) -> Column:
        return F.struct(order.alias("ord"), F.lit(sub).alias("sub"), token.alias("p"))

    late = F.when((value >= 30) & (value < 36), F.lit(1_000_000_000)).otherwise(F.lit(0))
    told = F.when(value < 4, None).when(value < 12, "click").otherwise(e["event_type"])
    return F.array(
        guess(event_id + late, 0, told),
        guess(event_id, 1, F.when(value > 140, "refund")),
        guess(event_id, 2, F.when((value > 110) & (value <= 140), e["event_type"])),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per hidden run: true and predicted activity lists."""
    events = _dated(table(spark, sf_dir, "events"))
    grouped = events.groupBy("user_id", "day").agg(
        F.array_sort(F.collect_list(F.struct("event_id", "event_type", "value"))).alias("items")
    )
    guesses = F.array_sort(
        F.filter(F.flatten(F.transform("items", _guesses)), lambda g: g["p"].isNotNull())
    )
    return grouped.select(
        "user_id", "day",
        occurrence_id(F.col("user_id"), F.col("day")).alias("case_id"),
        F.col("items")[0]["event_id"].alias("record_pos"),
        F.transform("items", lambda e: e["event_type"]).alias("true_members"),
        F.transform(guesses, lambda g: g["p"]).alias("pred"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with the fields scoring reads; lone errors are placeholders without e-mail."""
    return runs(spark, sf_dir).select(
        "*",
        F.array_join("true_members", ">").alias("unit_id"),
        F.size("true_members").cast("long").alias("declared_size"),
        ((F.col("user_id") % 10) / 10.0).alias("confidence"),
        (~F.array_contains(F.slice("true_members", 1, 1), "error")
         | (F.size("true_members") > 1)).alias("has_email"),
    )


# --- case graph ---------------------------------------------------------------------
#
# An order is a case occurrence of its customer; line items are evidence, suppliers
# actors, parts values shared between cases, fulfilled orders carry a leaky event.

VERBS = ["prepared", "reviewed", "ran", "completed", "approved", "signed_off"]


def application_id(customer: Column, order: Column) -> Column:
    return F.concat(F.lit("application_"), customer, F.lit("__"), order)


def _item_key() -> Column:
    return F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _nodes(rows: DataFrame, node_id: Column, label: str, pos: Column, **props) -> DataFrame:
    """Columns rather than rows of an array: what a query leaves out is not made."""
    return rows.select(
        node_id.alias("node_id"),
        pos.cast("long").alias("pos"),
        F.array(F.lit(label)).alias("labels"),
        (F.create_map(*[x for k, v in props.items() for x in (F.lit(k), v)]) if props
         else F.map_from_arrays(*[F.array().cast("array<string>")] * 2)).alias("props"),
    )


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    app = application_id(F.col("o_custkey"), key)
    per_order = [
        _nodes(orders, F.concat(F.lit("p"), key), "ProcessInstance", key,
               id=app, external_system_id=app, name=F.lit("Purchase order")),
        _nodes(orders, F.concat(F.lit("ac"), key), "ActivityCluster", key),
        _nodes(orders, F.concat(F.lit("d"), key), "DecisionNode", key,
               id=F.concat(F.lit("dec_"), key), final_choice=F.col("o_orderstatus"),
               decision_type=F.col("o_orderpriority")),
        _nodes(orders, F.concat(F.lit("r"), key), "RationaleNode", key,
               id=F.concat(F.lit("rat_"), key), text=F.col("o_orderpriority")),
        _nodes(orders.where("o_orderstatus = 'F'"), F.concat(F.lit("x"), key), "Event", key,
               name=F.col("o_orderstatus")),
    ]
    evidence = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        .agg(F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"))
        .select(
            F.concat(F.lit("e"), _item_key()).alias("node_id"),
            F.col("l_orderkey").cast("long").alias("pos"),
            F.array(F.lit("EvidenceNode")).alias("labels"),
            F.create_map(
                F.lit("id"), F.concat(
                    F.lit("ev_"), F.concat_ws("_", "l_orderkey", "l_partkey", "l_suppkey"),
                    F.lit("__s"), F.col("l_linenumber"),
                ),
                F.lit("text"), F.concat_ws(" ", "flag", "status"),
            ).alias("props"),
        )
    )
    actors = _nodes(
        table(spark, sf_dir, "supplier"), F.concat(F.lit("s"), F.col("s_suppkey")), "Actor",
        F.col("s_suppkey"), name=F.col("s_name"), actor_type=F.lit("Supplier"),
    )
    values = _nodes(
        table(spark, sf_dir, "part"), F.concat(F.lit("v"), F.col("p_partkey")), "ValueNode",
        F.col("p_partkey"), name=F.col("p_name"),
    )
    return _union([*per_order, evidence, actors, values])


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def edge(src: Column, rel: Column, dst: Column) -> Column:
        return F.struct(src.alias("src"), rel.alias("rel"), dst.alias("dst"))

    def node(prefix: str, key: str) -> Column:
        return F.concat(F.lit(prefix), F.col(key))

    o, item = "o_orderkey", F.concat(F.lit("e"), _item_key())
    per_order = table(spark, sf_dir, "orders").select(F.inline(F.filter(F.array(
        edge(node("ac", o), F.lit("part_of"), node("p", o)),
        edge(node("ac", o), F.lit("has_decision"), node("d", o)),
        edge(node("d", o), F.lit("justified_by"), node("r", o)),
        F.when(F.col("o_orderstatus") == "F", edge(node("x", o), F.lit("names"), node("ac", o))),
    ), lambda e: e.isNotNull())))
    l, verbs = "l_orderkey", F.array(*[F.lit(v) for v in VERBS])
    first = F.col("l_linenumber") == 1
    per_item = table(spark, sf_dir, "lineitem").select(F.inline(F.filter(F.array(
        edge(node("ac", l), F.lit("produced"), item),
        edge(node("s", "l_suppkey"),
             F.element_at(verbs, F.least(F.col("l_linenumber"), F.lit(6))), node("ac", l)),
        F.when(first, edge(node("d", l), F.lit("supported_by"), item)),
        F.when(first & (F.col("l_returnflag") == "R"),
               edge(node("d", l), F.lit("about"), node("v", "l_partkey"))),
    ), lambda e: e.isNotNull())))
    return per_order.unionByName(per_item)


# --- vectors ------------------------------------------------------------------------------

def vector_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision per embedding: first half text vector, second half structure vector."""
    vectors = table(spark, sf_dir, "embeddings")
    vec = F.col("embedding").cast("array<double>")
    half = F.floor(F.size(vec) / 2).cast("int")
    return vectors.select(
        F.concat(F.lit("d"), F.col("vec_id")).alias("node_id"),
        F.col("vec_id").alias("pos"),
        F.array(F.lit("DecisionNode")).alias("labels"),
        F.create_map(F.lit("id"), F.concat(F.lit("dec_"), F.col("vec_id"))).alias("props"),
        F.slice(vec, F.lit(1), half).alias("text_vec"),
        F.slice(vec, half + 1, F.size(vec) - half).alias("struct_vec"),
        vector_app("label", "vec_id").alias("app"),
    )


def rationale_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rationale per embedding, its vectors the halves the other way round, with a text."""
    return vector_nodes(spark, sf_dir).select(
        F.concat(F.lit("r"), F.col("pos")).alias("node_id"), "pos",
        F.array(F.lit("RationaleNode")).alias("labels"),
        F.create_map(
            F.lit("id"), F.concat(F.lit("rat_"), F.col("pos")), F.lit("text"), F.col("app")
        ).alias("props"),
        F.col("struct_vec").alias("text_vec"), F.col("text_vec").alias("struct_vec"), "app",
    )


def vector_app(label: str, vec_id: str) -> Column:
    """The label is the base case, the last digit's half the occurrence."""
    return F.concat(F.lit("application_"), F.col(label), F.lit("__"), F.col(vec_id) % 5)


# --- logs, mails, responses ------------------------------------------------------------------

# Activity classes; "refund" is deliberately not among them.
CATALOG = {
    "signup": "a new account is opened",
    "error": "a request could not be served",
    "click": "an element of a page is chosen",
    "view": "a page is shown",
    "purchase": "an order is paid",
}


class FixedCatalog(Catalog):
    """The catalog above, without a file."""

    def __init__(self):
        self.text = "\n".join(f"- {k}: {v}" for k, v in CATALOG.items())
        self.canonical = {k.lower(): k for k in CATALOG}


def catalog_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON array: every event type as it is and, after it, with a capital."""
    types = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    entry = types.select(F.inline(F.array(*[
        F.struct(
            spelling.alias("event_type"), F.concat(F.lit("seen "), "n", F.lit(" times")).alias("description")
        ) for spelling in (F.col("event_type"), F.initcap("event_type"))
    ])))
    by_name = F.struct(F.lower("event_type"), (F.col("event_type") != F.lower("event_type")),
                       F.struct("event_type", "description").alias("entry"))
    return entry.agg(F.to_json(F.transform(
        F.array_sort(F.collect_list(by_name)), lambda x: x["entry"]
    )).alias("value"))


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of each conversation, in order, as the mail of the user of that number."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("user_id")).agg(
        F.array_join(turns["text"], "\n").alias("body")
    )


def mail_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with a mail (where the user has one) and the timeline around it."""
    return runs_with_times(spark, sf_dir).join(mails(spark, sf_dir), "user_id", "left").select(
        "record_pos", "case_id", F.col("case_id").alias("graph_key"),
        F.lit(None).cast("string").alias("email_uid"), "user_id",
        F.col("body").isNotNull().alias("has_email"),
        F.when(F.col("body").isNotNull(), F.struct(
            F.left("body", F.lit(40)).alias("subject"), F.col("body"),
            F.lit("user").alias("sender"),
            F.concat(F.lit("u"), F.col("user_id"), F.lit("| ")).alias("objects"),
        )).alias("email"),
        timeline(F.col("items")).alias("observed_timeline"), "items",
    )


def runs_with_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "user_id", F.date_format("ts", "yyyyMMdd").alias("day"),
        "event_id", "event_type",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"),
    )
    return events.groupBy("user_id", "day").agg(
        F.array_sort(F.collect_list(F.struct("event_id", "event_type", "time"))).alias("items")
    ).select(
        "user_id", F.col("items")[0]["event_id"].alias("record_pos"), "items",
        occurrence_id(F.col("user_id"), F.col("day")).alias("case_id"),
    )


def _is_middle(items: Column, index: Column) -> Column:
    return index == F.floor(F.size(items) / 2)


def timeline(items: Column) -> Column:
    """Observed timeline text: the middle event is the hidden mail."""
    shown = F.transform(items, lambda e, i: F.when(
        _is_middle(items, i), ">>> THIS hidden email TO RECONSTRUCT (activities unknown) <<<"
    ).otherwise(F.concat(F.lit("- "), e["time"], F.lit(" | "), e["event_type"])))
    return F.concat(
        F.lit("OBSERVED CASE TIMELINE (offline): use BOTH sides.\n\n"),
        F.array_join(shown, "\n"), F.lit("\n"),
    )


def log_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_key, document): each run's log as JSON, answer attributes included."""
    def attribute(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    records = mail_records(spark, sf_dir)
    items = F.col("items")
    events = F.transform(items, lambda e, i: F.struct(
        F.when(_is_middle(items, i), "internal_email_sent").otherwise(e["event_type"]).alias("type"),
        e["time"].alias("time"),
        F.when(_is_middle(items, i), F.array(
            attribute("EmailID", F.concat(F.lit("m"), e["event_id"].cast("string"))),
            attribute("Sender", F.col("email.sender")),
            attribute("Subject", F.col("email.subject")),
            attribute("Body", F.col("email.body")),
            attribute("true_members", F.concat(F.lit("SECRET "), e["event_type"])),
        )).alias("attributes"),
        F.array(F.struct(F.concat(F.lit("u"), F.col("user_id")).alias("objectId")))
        .alias("relationships"),
    ))
    return records.select(
        F.col("case_id").alias("graph_key"), F.to_json(F.struct(events.alias("events"))).alias("document")
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's raw answer per run: fenced, upper-cased, bare or broken ones among them."""
    base = records(spark, sf_dir)
    pred = F.col("pred")
    loud = F.transform(pred, lambda x: F.concat(F.lit(" "), F.upper(x), F.lit("\t")))
    listed = F.when(F.element_at("true_members", 1) == "view", loud).otherwise(pred)
    confidence = F.when(F.array_contains(pred, "error") & (F.size(pred) > 3), F.lit('"high"')
                        ).otherwise(F.col("confidence").cast("string"))
    activities = F.when(F.size(pred) == 1, F.concat(F.lit('"'), pred[0], F.lit('"'))).otherwise(
        F.to_json(listed)
    )
    body = F.concat(F.lit('{"activities": '), activities, F.lit(', "confidence": '), confidence,
                    F.lit(', "reasoning": "as told"}'))
    raw = (
        F.when(F.size(pred) == 0, "I cannot tell {from this}.")
        .when(F.array_contains(pred, "refund"), F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(F.element_at("true_members", -1) == "click",
              F.concat(F.lit("Here it is: "), body, F.lit(" Done.")))
        .otherwise(body)
    )
    return base.select("record_pos", "case_id", "has_email", "pred", raw.alias("raw"),
                       F.col("confidence").alias("stated"))


def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One piece of evidence per document, its whole text as property."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.create_map(F.lit("text"), F.col("text")).alias("props")
    )


# --- dump and record lines ------------------------------------------------------------------------

def _placed(lines: DataFrame) -> DataFrame:
    """Lines with the position that reading them from a file would give."""
    return lines.select(
        F.struct(
            F.lit("").alias("file"), F.spark_partition_id().cast("long").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("pos"),
        "line",
    )


def dump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph as dump lines (pos, line).

    Values come as ends of relationships only; every node that is the start of
    one is repeated there without properties, and each actor adds a broken line.
    """
    nodes = graph_nodes(spark, sf_dir)
    labels = nodes.select("node_id", "labels", "props")
    typed = F.transform_values(
        "props", lambda k, v: F.struct(F.lit("String").alias("type"), v.alias("value"))
    )
    own = nodes.where("labels[0] <> 'ValueNode'").select(
        F.concat(F.to_json(F.struct(
            F.lit("node").alias("type"), F.col("node_id").alias("id"),
            F.concat(F.array(F.lit("__Entity__")), "labels").alias("labels"),
            typed.alias("properties"),
        )), F.lit(",")).alias("line"),
    )
    broken = nodes.where("labels[0] = 'Actor'").select(
        F.concat(F.lit('{"type": "node", "id": "'), "node_id").alias("line"),
    )
    end = labels.select(F.col("node_id").alias("dst"), F.struct(
        F.col("node_id").alias("id"), "labels", F.col("props").alias("properties")
    ).alias("end"))
    ties = graph_edges(spark, sf_dir).join(end, "dst").select(
        F.to_json(F.struct(
            F.lit("relationship").alias("type"), F.col("rel").alias("label"),
            F.struct(F.col("src").alias("id"), F.array(F.lit("inline_text")).alias("labels"))
            .alias("start"), F.col("end"),
        )).alias("line"),
    )
    return _placed(own.unionByName(broken).unionByName(ties))


def vector_dump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as typed JSON lists; label 0 lacks the structure vector."""
    nodes = vector_nodes(spark, sf_dir)
    wrapped = F.struct(
        F.lit("List").alias("type"),
        F.transform("text_vec", lambda x: F.struct(F.lit("Double").alias("type"), x.alias("value")))
        .alias("value"),
    )
    bare = F.when(~F.startswith("app", F.lit("application_0__")), F.col("struct_vec"))
    return _placed(nodes.select(F.to_json(F.struct(
        F.lit("node").alias("type"), F.col("node_id").alias("id"), "labels",
        F.struct(F.col("props")["id"].alias("id"), wrapped.alias("text_embedding"),
                 bare.alias("fastrp_embedding")).alias("properties"),
    )).alias("line")))


def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON lines; one-event runs declare a size of 0."""
    rows = records(spark, sf_dir)
    subject = F.when(F.col("has_email"), F.struct(F.col("case_id").alias("subject")))
    short = F.size("true_members") == 1
    return rows.select("record_pos", F.to_json(F.struct(
        "case_id", "unit_id", subject.alias("email"), "true_members", "pred", "confidence",
        F.when(short, F.lit(0)).alias("gram_size"), F.col("declared_size").alias("size"),
    )).alias("line"))
