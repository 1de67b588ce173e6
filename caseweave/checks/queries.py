"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.checks import tables as T
from caseweave.fixed import HIT_CLIP, MEAN_METRICS
from caseweave.functions import text
from caseweave.functions.sequences import with_pair_metrics
from caseweave.operators import graph, guards, render, similarity, timeline, walk
from caseweave.operators.links import IdGraph, WalkGraph
from caseweave.plans import context, predictions, prompts, reports, scoring
from caseweave.runtime import materialise, written_path
from caseweave.sources import event_log, graph_dump
from caseweave.sources import records as record_source

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Fix the digits compared: sums of doubles depend on the order of addition."""
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


# --- pairs ------------------------------------------------------------------------

def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_pair_metrics(T.runs(spark, sf_dir), "true_members", "pred")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(T.records(spark, sf_dir))


@query
def hidden_runs(spark, sf_dir):
    return T.runs(spark, sf_dir).select(
        "case_id", "record_pos",
        F.array_join("true_members", ">").alias("true_list"),
        F.array_join("pred", ">").alias("pred_list"),
    )


@query
def pair_edit_distance(spark, sf_dir):
    return rounded(
        _pairs(spark, sf_dir).select("case_id", "edit_distance", "normalized_edit_distance"),
        "normalized_edit_distance",
    )


@query
def pair_lcs(spark, sf_dir):
    measures = ["lcs_ratio", "seq_precision", "seq_recall", "seq_f1"]
    return rounded(_pairs(spark, sf_dir).select("case_id", "lcs_length", *measures), *measures)


@query
def pair_overlap(spark, sf_dir):
    measures = [
        "multiset_precision", "multiset_recall", "multiset_f1", "jaccard", "dice", "cosine",
    ]
    return rounded(_pairs(spark, sf_dir).select("case_id", *measures), *measures)


@query
def pair_kendall(spark, sf_dir):
    return rounded(_pairs(spark, sf_dir).select("case_id", "kendall_tau"), "kendall_tau")


@query
def pair_category(spark, sf_dir):
    return _pairs(spark, sf_dir).select("case_id", "category", "exact_match")


@query
def pair_fp_fn(spark, sf_dir):
    return scoring.fp_fn(_pairs(spark, sf_dir))


@query
def alignment_ops(spark, sf_dir):
    return _pairs(spark, sf_dir).select(
        "case_id",
        F.col("ops.match").alias("n_match"),
        F.col("ops.sub").alias("n_sub"),
        F.col("ops.ins").alias("n_ins"),
        F.col("ops.del").alias("n_del"),
        F.array_join(F.transform("subs", lambda s: F.concat(s["true"], F.lit(">"), s["pred"])),
                     ",").alias("subs"),
    )


# --- aggregates over the scored rows -----------------------------------------------

@query
def scored_rows(spark, sf_dir):
    return rounded(
        _scored(spark, sf_dir).select(
            "record_pos", "unit_id", "size", "case_id", "confidence", "category", "exact_match",
            "true_length", "pred_length", "length_bias", "edit_distance", "multiset_f1", "seq_f1",
        ),
        "confidence", "multiset_f1", "seq_f1",
    )


@query
def run_counts(spark, sf_dir):
    return scoring.run_counts(T.records(spark, sf_dir))


@query
def confusion_by_size(spark, sf_dir):
    return scoring.confusion_cells(_scored(spark, sf_dir))


@query
def confusion_cells(spark, sf_dir):
    return scoring.overall_cells(scoring.confusion_cells(_scored(spark, sf_dir)))


@query
def confusion_labels(spark, sf_dir):
    return scoring.confusion_label_list(confusion_cells(spark, sf_dir))


@query
def confusion_matrix_dense(spark, sf_dir):
    return scoring.dense_matrix(materialise(confusion_cells(spark, sf_dir), "cells"))


@query
def confusion_matrix_sparse(spark, sf_dir):
    cells = materialise(confusion_cells(spark, sf_dir), "cells")
    return scoring.sparse_matrix(scoring.dense_matrix(cells))


@query
def confusion_totals(spark, sf_dir):
    rates = ["match_rate", "sub_rate", "ins_rate", "del_rate"]
    return rounded(
        scoring.confusion_totals(scoring.confusion_cells(_scored(spark, sf_dir)), ["size"]), *rates
    )


@query
def substitution_list(spark, sf_dir):
    return scoring.substitutions(confusion_cells(spark, sf_dir))


@query
def substitutions_by_size(spark, sf_dir):
    return scoring.substitutions(confusion_by_size(spark, sf_dir), ("size",))


@query
def confusion_matrix_by_size(spark, sf_dir):
    cells = materialise(confusion_by_size(spark, sf_dir), "cells")
    return scoring.dense_matrix(cells, ("size",))


@query
def confusion_sparse_by_size(spark, sf_dir):
    return scoring.sparse_matrix(confusion_matrix_by_size(spark, sf_dir))


@query
def confusion_labels_by_size(spark, sf_dir):
    return scoring.confusion_label_list(confusion_by_size(spark, sf_dir), ("size",))


@query
def scored_row_lines(spark, sf_dir):
    """Scored rows as JSON lines, read again."""
    counts, joined = "map<string,int>", ">"
    kind = (
        f"unit_id string, size long, case_id string, true array<string>, pred array<string>, "
        f"confidence double, category string, fp {counts}, fn {counts}, "
        "ops struct<match: long, sub: long, ins: long, del: long>, "
        "subs array<struct<true: string, pred: string>>"
    )

    def told(name):
        entries = F.array_sort(F.map_entries(name))
        return F.array_join(
            F.transform(entries, lambda x: F.concat_ws("=", x["key"], x["value"])), ","
        ).alias(name)

    lines = reports.scored_lines(_scored(spark, sf_dir))
    row = lines.select("record_pos", F.from_json("line", kind).alias("x")).select("record_pos", "x.*")
    return rounded(row.select(
        "record_pos", "unit_id", "size", "case_id", "confidence", "category",
        F.array_join("true", joined).alias("true_list"), F.array_join("pred", joined).alias("pred_list"),
        told("fp"), told("fn"),
        F.concat_ws(",", "ops.match", "ops.sub", "ops.ins", "ops.del").alias("ops"),
        F.array_join(F.transform("subs", lambda s: F.concat_ws(">", s["true"], s["pred"])), ",")
        .alias("subs"),
    ), "confidence")


@query
def summary_grouping_sets(spark, sf_dir):
    stats = [*MEAN_METRICS, *[f"{m}_std" for m in MEAN_METRICS], "exact_rate"]
    return rounded(scoring.summary(_scored(spark, sf_dir)), *stats)


@query
def category_mix(spark, sf_dir):
    return scoring.category_mix(_scored(spark, sf_dir))


# --- case graph ---------------------------------------------------------------------

def _all_cases(nodes: DataFrame) -> DataFrame:
    return nodes.where("app_id is not null").select(F.col("app_id").alias("asked")).distinct()


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.node_table(T.graph_nodes(spark, sf_dir))


def _case_graph(spark: SparkSession, sf_dir: str, mask: bool = True) -> context.CaseGraph:
    return context.CaseGraph(
        T.graph_nodes(spark, sf_dir), T.graph_edges(spark, sf_dir), mask, keep_props=False
    )


@query
def graph_nodes(spark, sf_dir):
    return _nodes(spark, sf_dir).select(
        "node_id", "label", "stable_id", "span", "app_id", "is_boundary", "is_leaky"
    )


@query
def graph_adjacency(spark, sf_dir):
    return graph.adjacency(_nodes(spark, sf_dir), T.graph_edges(spark, sf_dir)).select(
        "src", "dst", "src_app", "dst_actor", "dst_boundary", "dst_leaky"
    )


@query
def alias_resolution(spark, sf_dir):
    return graph.case_ids(_nodes(spark, sf_dir))


@query
def alias_fanout(spark, sf_dir):
    return graph.alias_fanout(_nodes(spark, sf_dir))


def _around(spark, sf_dir, hops, **options) -> DataFrame:
    g = _id_graph(spark, sf_dir)
    seeds = walk.case_seeds(_case_nodes(g), g)
    return g.names(walk.neighbourhood(seeds, g, hops, **options)).select("asked", "node_id")


def _walk_graph(spark: SparkSession, sf_dir: str) -> WalkGraph:
    return WalkGraph(T.graph_nodes(spark, sf_dir), T.graph_edges(spark, sf_dir), keep_props=False)


def _id_graph(spark: SparkSession, sf_dir: str) -> IdGraph:
    return IdGraph(T.graph_nodes(spark, sf_dir), T.graph_edges(spark, sf_dir))


def _case_nodes(g: WalkGraph) -> DataFrame:
    """Every application by its id: (asked, node)."""
    return g.case_numbers(graph.resolve(_all_cases(g.nodes), g.nodes))


@query
def case_neighbourhood_1(spark, sf_dir):
    return _around(spark, sf_dir, 1)


@query
def case_neighbourhood_2(spark, sf_dir):
    return _around(spark, sf_dir, 2)


@query
def case_neighbourhood_leaky(spark, sf_dir):
    """One hop, nodes that tell the answer among what is reached."""
    return _around(spark, sf_dir, 1, keep_leaky=True)


@query
def node_owner(spark, sf_dir):
    return walk.owners(_walk_graph(spark, sf_dir))


@query
def case_seed_ids(spark, sf_dir):
    g = _id_graph(spark, sf_dir)
    seeds = walk.case_seeds(_case_nodes(g), g)
    return walk.seed_ids(walk.neighbourhood(seeds, g, 2), g)


def _named_ends(g: IdGraph, edges: DataFrame) -> DataFrame:
    for side in ("src", "dst"):
        edges = g.named_members(edges.withColumnRenamed(side, "node")).drop("node").withColumnRenamed("node_id", side)
    return edges


@query
def masked_edges(spark, sf_dir):
    g = _id_graph(spark, sf_dir)
    return _named_ends(g, render.masked_edges(g.edges, graph=g)).select("src", "rel", "dst")


@query
def bare_case_drop(spark, sf_dir):
    """Sets of a case node alone, which goes, and of cases with their clusters, which stay."""
    g = _walk_graph(spark, sf_dir)
    alone = _case_nodes(g)
    clustered = walk.case_seeds(alone, g).withColumn(
        "asked", F.concat("asked", F.lit("#clusters"))
    )
    sets = materialise(alone.unionByName(clustered), "reached")
    return g.names(walk.without_bare_cases(sets, g)).select("asked", "node_id")


@query
def induced_edges(spark, sf_dir):
    g = _id_graph(spark, sf_dir)
    seeds = walk.case_seeds(_case_nodes(g), g)
    members = materialise(g.named_members(walk.neighbourhood(seeds, g, 2)), "members")
    tied = walk.induced_edges(members, render.masked_edges(g.edges, graph=g), tag="node_id")
    return tied.select("asked", F.col("src_tag").alias("src"), "rel", F.col("dst_tag").alias("dst"))


@query
def render_subgraph(spark, sf_dir):
    g = _case_graph(spark, sf_dir)
    return g.case_lines(_all_cases(g.nodes), 2, this_email=True)


@query
def render_unmasked(spark, sf_dir):
    """One hop, with the verbs of execution as they are."""
    g = _case_graph(spark, sf_dir, mask=False)
    return g.case_lines(_all_cases(g.nodes), 1, this_email=True)


@query
def subgraph_text(spark, sf_dir):
    g = _case_graph(spark, sf_dir)
    return g.case_texts(_all_cases(g.nodes), 1, this_email=True)


@query
def evidence_spans(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return nodes.where("label = 'EvidenceNode'").select(
        "stable_id", "span",
        text.base_case(F.col("stable_id")).alias("base"),
        text.evidence_details(F.col("props"), F.lit(True), F.col("span")).alias("details"),
        text.format_props(F.col("props")).alias("props"),
    )


# --- similarity ---------------------------------------------------------------------------

def _pool(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    raw = T.vector_nodes(spark, sf_dir)
    nodes = graph.node_table(raw.drop("app"))
    return nodes, similarity.candidates(nodes, raw.select("node_id", "app"))


def _requests(pool: DataFrame, k: int, current_app) -> DataFrame:
    return pool.select(
        F.col("node_id").alias("request_id"), "kind", F.col("stable_id").alias("query_id"),
        F.lit(k).alias("k"), current_app.alias("current_app"),
    )


def _hits(spark, sf_dir, k, current_app, **options) -> DataFrame:
    _, pool = _pool(spark, sf_dir)
    queries = similarity.query_rows(_requests(pool, k, current_app), pool)
    hits = similarity.top_k(queries, pool, **options)
    measures = ["score", "semantic", "structural"]
    return rounded(hits.select("request_id", "rank", "node_id", "app", *measures), *measures)


@query
def hybrid_topk(spark, sf_dir):
    """Own application out, siblings allowed."""
    return _hits(spark, sf_dir, 5, F.lit(None).cast("string"), exclude_same_case=False)


@query
def guarded_topk(spark, sf_dir):
    """Siblings of the query's case out as well, text weighted higher."""
    return _hits(spark, sf_dir, 3, F.lit(""), alpha=0.7)


@query
def chained_guard_topk(spark, sf_dir):
    """Each query asked on behalf of another case, which must not come back either."""
    target = F.concat(F.lit("application_"), F.length("node_id"), F.lit("__0"))
    return _hits(spark, sf_dir, 4, target)


@query
def vector_gate(spark, sf_dir):
    nodes, _ = _pool(spark, sf_dir)
    similarity.check_vectors(nodes)
    return similarity.vector_sizes(nodes)


# --- reports --------------------------------------------------------------------------------

def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.summary(_scored(spark, sf_dir))


@query
def summary_export(spark, sf_dir):
    return reports.summary_export(_summary(spark, sf_dir))


@query
def report_table(spark, sf_dir):
    return reports.metric_table(_summary(spark, sf_dir))


@query
def unit_report(spark, sf_dir):
    return reports.unit_table(_summary(spark, sf_dir))


@query
def ops_report(spark, sf_dir):
    return reports.ops_report(scoring.confusion_cells(_scored(spark, sf_dir)))


@query
def summary_lines(spark, sf_dir):
    """The summary's JSON lines, their main fields read again."""
    scored = _scored(spark, sf_dir)
    lines = reports.summary_json(
        scoring.run_counts(T.records(spark, sf_dir)), scoring.summary(scored),
        scoring.category_mix(scored),
        scoring.confusion_totals(scoring.confusion_cells(scored), ["size"]),
    )

    def read(name, kind="string"):
        return F.get_json_object("line", f"$.{name}").cast(kind).alias(name)

    numbers = ("size", "n", "n_records", "n_scored", "n_match", "n_sub", "n_ins", "n_del")
    return lines.select(
        "scope", read("unit_id"), read("categories"), *[read(n, "long") for n in numbers]
    )


@query
def summary_document(spark, sf_dir):
    """The one document written in parts, read again, and the matrices in it taken apart."""
    scored = materialise(_scored(spark, sf_dir), "scored")
    path = written_path(spark, "summary")
    reports.write_document(reports.summary_document(
        scoring.run_counts(T.records(spark, sf_dir)), scoring.summary(scored),
        scoring.category_mix(scored), scoring.confusion_cells(scored),
    ), path)
    lines = spark.read.text(path).select(
        F.struct(F.col("_metadata.file_name"), F.monotonically_increasing_id().alias("i"), "value").alias("x")
    )
    report = "labels array<string>, matrix array<array<long>>"
    whole = lines.agg(F.array_join(
        F.transform(F.array_sort(F.collect_list("x")), lambda x: x["value"]), "\n"
    ).alias("text")).select(F.from_json(
        "text", f"confusion struct<{report}, by_size map<string, struct<{report}>>>",
    )["confusion"].alias("c"))
    reports_ = whole.select(F.lit(None).cast("long").alias("size"), "c.labels", "c.matrix").unionByName(
        whole.select(F.explode("c.by_size").alias("size", "r")).select(
            F.col("size").cast("long").alias("size"), "r.labels", "r.matrix"
        )
    )
    rows = reports_.select("size", "labels", F.posexplode("matrix").alias("i", "row"))
    return rows.select(
        "size", F.get("labels", F.col("i")).alias("true_label"), F.posexplode("row").alias("j", "n"), "labels"
    ).select("size", "true_label", F.get("labels", F.col("j")).alias("pred_label"), "n")


# --- event logs -----------------------------------------------------------------------------

def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log.parse_logs(T.log_documents(spark, sf_dir))


@query
def nested_log_flatten(spark, sf_dir):
    return event_log.flatten(_logs(spark, sf_dir)).select(
        "graph_key", "pos", "type", "time",
        timeline.attribute(F.col("attributes"), "EmailID").alias("email_id"),
        F.array_join("object_ids", ",").alias("objects"),
    )


@query
def case_timeline(spark, sf_dir):
    """Lines with the mail shown."""
    return timeline.timeline_lines(event_log.flatten(_logs(spark, sf_dir)), use_email=True)


@query
def case_timeline_redacted(spark, sf_dir):
    logs = _logs(spark, sf_dir)
    lines = timeline.timeline_lines(event_log.flatten(logs), use_email=False)
    return timeline.timeline_texts(logs, lines)


@query
def log_requests(spark, sf_dir):
    """Every run's log asked for by case id, by graph key, and by an id nobody has.

    Customers are records too, but have no log.
    """
    runs = _log_records(spark, sf_dir)
    lost = T.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("customer_"), F.col("c_custkey")).alias("graph_key"),
        F.col("c_custkey").cast("long").alias("record_pos"),
    ).withColumn("case_id", F.col("graph_key"))
    asked = runs.select(F.explode(F.array(
        F.col("case_id"), F.col("graph_key"), F.concat(F.lit("no_"), F.col("graph_key"))
    )).alias("application_id")).union(lost.select("graph_key"))
    keys = timeline.log_keys(runs.unionByName(lost))
    return timeline.answer(asked, keys, _log_texts(spark, sf_dir))


def _log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose case id is spelled unlike their graph key."""
    return T.mail_records(spark, sf_dir).select(
        F.regexp_replace("case_id", "^a", "A").alias("case_id"), "graph_key",
        F.col("record_pos").cast("long").alias("record_pos"),
    )


def _log_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = _logs(spark, sf_dir)
    lines = timeline.timeline_lines(event_log.flatten(logs), use_email=True)
    return timeline.timeline_texts(logs, lines)


@query
def guarded_log_requests(spark, sf_dir):
    """Each log asked for by the case itself, under its other name, by a sibling and by others."""
    runs = _log_records(spark, sf_dir)
    own, other = F.col("graph_key"), F.col("case_id")

    def ask(application_id, current_app):
        return F.struct(application_id.alias("application_id"), current_app.alias("current_app"))

    sibling = F.concat(F.substring_index("graph_key", "__", 1), F.lit("__none"))
    asked = runs.select(F.inline(F.array(
        ask(own, own), ask(other, own), ask(own, other), ask(other, sibling),
        ask(own, F.lit("application_none__1")), ask(other, F.lit(None).cast("string")),
        ask(F.concat(F.lit("no_"), own), own),
    )))
    return context.answer_log_requests(asked, timeline.log_keys(runs), _log_texts(spark, sf_dir))


# --- guards and gates -----------------------------------------------------------------------

@query
def guarded_requests(spark, sf_dir):
    vectors = T.table(spark, sf_dir, "embeddings")
    asked = vectors.select(
        "vec_id", T.vector_app("label", "vec_id").alias("application_id"),
        F.when(F.col("label") < 5, F.concat(F.lit("application_"), "label", F.lit("__0")))
        .when(F.col("label") < 9, F.lit("application_0__1")).alias("current_app"),
    )
    strict = guards.guard(asked)
    lenient = guards.guard(asked, exclude_same_case=False)
    return strict.join(
        lenient.select("vec_id", F.col("verdict").alias("verdict_same_case_allowed")), "vec_id"
    )


def _order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's case asked for: on its own behalf, a sibling's, or a stranger's."""
    status, customer = F.col("o_orderstatus"), F.col("o_custkey")
    own = T.application_id(customer, F.col("o_orderkey"))
    return T.table(spark, sf_dir, "orders").select(
        own.alias("application_id"),
        F.when(status == "O", own)
        .when(status == "P", F.concat(F.lit("application_"), customer, F.lit("__none")))
        .otherwise("application_none__1").alias("current_app"),
    )


@query
def guarded_subgraph(spark, sf_dir):
    return _case_graph(spark, sf_dir).answer_subgraph_requests(
        _order_requests(spark, sf_dir), hops=1
    )


@query
def coverage_gate(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders")
    app = T.application_id(F.col("o_custkey"), F.col("o_orderkey"))
    asked = orders.select(
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(None)).otherwise(app)
        .alias("graph_key"),
        F.lit("application_none").alias("case_id"),
    )
    return rounded(guards.coverage(asked, _nodes(spark, sf_dir)), "coverage")


# --- retrieval texts --------------------------------------------------------------------------

@query
def case_subgraph_text(spark, sf_dir):
    """Every case by its id, one by a shared name, one that does not exist."""
    g = _case_graph(spark, sf_dir)
    apps = g.nodes.where("app_id is not null").select(F.explode(F.array(
        F.col("app_id"), F.try_element_at("props", F.lit("name")), F.lit("application_none")
    )).alias("asked")).distinct()
    return g.application_texts(apps, hops=2, this_email=True)


@query
def similar_context(spark, sf_dir):
    """Five most similar decisions of every decision, each with its neighbourhood."""
    raw = T.vector_nodes(spark, sf_dir)
    nodes = graph.node_table(raw.drop("app"))
    pool = similarity.candidates(nodes, raw.select("node_id", "app"))
    hits = context.similar_hits(
        nodes, raw.select("node_id", "app"),
        _requests(pool, 5, F.lit(None).cast("string")),
    )
    return _case_graph(spark, sf_dir).similar_texts(hits, "decision", 0.5, hops=1)


@query
def similar_rationales(spark, sf_dir):
    """Three most similar rationales of every rationale, text and neighbourhood shown."""
    raw = T.rationale_nodes(spark, sf_dir)
    nodes = graph.node_table(raw.drop("app"))
    owned = raw.select("node_id", "app")
    pool = similarity.candidates(nodes, owned)
    hits = context.similar_hits(
        nodes, owned, _requests(pool, 3, F.lit(None).cast("string")), alpha=0.7
    )
    return _case_graph(spark, sf_dir).similar_texts(hits, "rationale", 0.7, hops=1)


@query
def similar_answers(spark, sf_dir):
    """Rationales of one case's occurrences only, each asked for by its id and by one nobody has,
    and all decisions likewise: hits, nothing to compare with, and unknown ids."""
    rationales = T.rationale_nodes(spark, sf_dir).where(F.startswith("app", F.lit("application_0__")))
    raw = T.vector_nodes(spark, sf_dir).unionByName(rationales)
    nodes = materialise(graph.node_table(raw.drop("app")), "vectors")
    owned = raw.select("node_id", "app")
    pool = similarity.candidates(nodes, owned)
    known = _requests(pool, 1, F.lit(None).cast("string"))
    lost = known.withColumn("request_id", F.concat(F.lit("no_"), "request_id")).withColumn(
        "query_id", F.concat(F.lit("no_"), "query_id")
    )
    requests = materialise(known.unionByName(lost), "requests")
    hits = materialise(context.similar_hits(nodes, owned, requests), "hits")
    g = _case_graph(spark, sf_dir)

    def texts(noun, label):
        asked = requests.where(F.col("kind") == label).select("request_id")
        return g.similar_texts(hits.join(asked, "request_id", "left_semi"), noun, 0.5, hops=0)

    answers = [
        context.answer_similar_requests(requests, pool, hits, texts(noun, label), noun, label)
        for noun, label in (("decision", "DecisionNode"), ("rationale", "RationaleNode"))
    ]
    return answers[0].unionByName(answers[1])


# --- prompts ------------------------------------------------------------------------------------

@query
def clipped_texts(spark, sf_dir):
    """Texts beyond both limits, as evidence, as a property and as a hit."""
    nodes = T.document_nodes(spark, sf_dir)
    raw = F.try_element_at("props", F.lit("text"))
    return nodes.select(
        "doc_id",
        text.evidence_details(F.col("props"), F.lit(False), F.lit(0)).alias("details"),
        text.format_props(F.col("props")).alias("props"),
        text.clip(F.coalesce(raw, F.lit("")), HIT_CLIP).alias("hit"),
    )


@query
def timeline_text(spark, sf_dir):
    return T.mail_records(spark, sf_dir).select(
        "record_pos",
        text.timeline_text(F.col("observed_timeline"), True, F.col("graph_key")).alias("timeline"),
        text.objects_list(F.col("email.objects")).alias("objects"),
    )


@query
def prompt_table(spark, sf_dir):
    records = predictions.predictable(T.mail_records(spark, sf_dir), True, False)
    return prompts.prompts(records, T.FixedCatalog(), cap=3)


@query
def prompt_single(spark, sf_dir):
    """One activity asked for, mail and timeline shown."""
    records = predictions.predictable(T.mail_records(spark, sf_dir), True, False)
    return prompts.prompts(records, T.FixedCatalog(), single=True)


@query
def prompt_dedup(spark, sf_dir):
    """Mail only: runs of one user share a prompt, runs without a mail another one."""
    made = prompts.prompts(T.mail_records(spark, sf_dir), T.FixedCatalog(), use_timeline=False)
    return prompts.to_send(made).select("prompt_key", "n_records", "record_pos")


@query
def prompt_table_graph(spark, sf_dir):
    g = _case_graph(spark, sf_dir)
    app = T.application_id(F.col("o_custkey"), F.col("o_orderkey"))
    records = T.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("record_pos"), app.alias("graph_key"),
        F.lit("").alias("case_id"), F.lit(None).cast("string").alias("email_uid"),
        F.concat_ws("", F.lit("OBSERVED CASE TIMELINE (offline): use BOTH sides.\n\n- "),
                    F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" | "), "o_orderstatus",
                    F.lit("\n")).alias("observed_timeline"),
    )
    asked = records.select(F.col("graph_key").alias("asked"))
    texts = g.application_texts(asked, hops=2, this_email=True)
    return prompts.graph_prompts(records, T.FixedCatalog(), texts, g.seed_lists(asked, hops=2))


def _answers(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return predictions.parse_responses(
        T.responses(spark, sf_dir), T.FixedCatalog(), **options
    )


@query
def prompt_audit(spark, sf_dir):
    records = T.mail_records(spark, sf_dir)
    made = materialise(
        prompts.prompts(records, T.FixedCatalog(), use_timeline=False), "prompts"
    )
    firsts = prompts.to_send(made).select("record_pos", "prompt_key")
    answers = _answers(spark, sf_dir).join(firsts, "record_pos").select(
        "prompt_key", "raw", "error"
    )
    shared = prompts.share_answers(made, answers)
    return prompts.audit(records, made, shared)


# --- answers --------------------------------------------------------------------------------------

@query
def response_normalise(spark, sf_dir):
    return rounded(_answers(spark, sf_dir, max_activities=4).select(
        "record_pos", F.array_join("pred", ">").alias("pred"), "confidence", "error"
    ), "confidence")


@query
def response_normalise_agent(spark, sf_dir):
    return rounded(_answers(spark, sf_dir, agent=True).select(
        "record_pos", F.array_join("pred", ">").alias("pred"), "confidence", "error"
    ), "confidence")


@query
def response_single(spark, sf_dir):
    """Only the first activity of an answer counts."""
    return _answers(spark, sf_dir, single=True).select(
        "record_pos", F.array_join("pred", ">").alias("pred"), "error"
    )


@query
def response_outcomes(spark, sf_dir):
    return predictions.failure_rate(_answers(spark, sf_dir))


@query
def predictions_echo(spark, sf_dir):
    """Predictions of the records with a mail, put back onto all of them."""
    records = T.records(spark, sf_dir)
    asked = predictions.predictable(records, use_email=True, use_graph=False)
    answers = _answers(spark, sf_dir).join(asked.select("record_pos"), "record_pos", "left_semi")
    return rounded(predictions.onto_records(records, answers).select(
        "record_pos", "case_id", F.array_join("pred", ">").alias("pred"), "confidence"
    ), "confidence")


@query
def predictions_echo_lines(spark, sf_dir):
    """Record lines with their prediction set, read again."""
    records = record_source.parse_records(T.record_lines(spark, sf_dir))
    asked = predictions.predictable(records, use_email=True, use_graph=False)
    answers = _answers(spark, sf_dir).join(asked.select("record_pos"), "record_pos", "left_semi")
    back = record_source.parse_records(record_source.echo_lines(records, answers))
    return rounded(back.select(
        "record_pos", "case_id", "unit_id", "declared_size", F.col("email.subject").alias("subject"),
        F.array_join("true_members", ">").alias("true_list"),
        F.array_join("pred", ">").alias("pred"), "confidence",
    ), "confidence")


# --- scans ----------------------------------------------------------------------------------------

@query
def graph_json_scan(spark, sf_dir):
    """The test graph written as dump lines, some of them broken, and read back."""
    nodes = graph.node_table(graph_dump.Dump(T.dump_lines(spark, sf_dir)).nodes)
    return nodes.select(
        "node_id", "label", "stable_id", "app_id", text.format_props(F.col("props")).alias("props")
    )


@query
def graph_json_edges(spark, sf_dir):
    return graph_dump.Dump(T.dump_lines(spark, sf_dir)).edges


@query
def graph_json_rejects(spark, sf_dir):
    """Counted by the pass that parses the lines."""
    dump = graph_dump.Dump(T.dump_lines(spark, sf_dir))
    return spark.createDataFrame(
        [(dump.n_lines, dump.n_rejected)], "n_lines long, n_rejected long"
    )


@query
def vector_json_scan(spark, sf_dir):
    """Embeddings as typed JSON values, unwrapped again."""
    nodes = graph.node_table(graph_dump.Dump(T.vector_dump_lines(spark, sf_dir)).nodes)
    total = F.aggregate("text_vec", F.lit(0.0), lambda a, x: a + x)
    return rounded(nodes.select(
        "node_id", "stable_id", F.size("text_vec").alias("n_text"), total.alias("text_sum"),
        F.col("struct_vec").isNull().alias("lacks_structure"),
    ), "text_sum")


@query
def catalog_scan(spark, sf_dir):
    """A catalog of the event types, each in two spellings, read from its JSON text."""
    entries = record_source.parse_catalog(T.catalog_document(spark, sf_dir))
    catalog = record_source.Catalog(entries)
    shown = F.create_map(*[F.lit(x) for pair in catalog.canonical.items() for x in pair])
    return entries.select(
        "pos", "event_type", "description",
        F.element_at(shown, F.lower("event_type")).alias("canonical"),
        F.lit(catalog.text).alias("catalog"),
    )


@query
def records_by_fallback(spark, sf_dir):
    """Record lines written under a longer name than asked for, found and read."""
    folder = written_path(spark, "inputs")
    record_source.write_lines(T.record_lines(spark, sf_dir), f"{folder}/hidden_mails.jsonl")
    path = record_source.resolve_input(spark, folder, "hidden")
    read = record_source.parse_records(record_source.read_lines(spark, path))
    return read.select(
        "case_id", "unit_id", "has_email", "declared_size",
        F.array_join("true_members", ">").alias("true_list"),
    )


@query
def records_json_scan(spark, sf_dir):
    return rounded(record_source.parse_records(T.record_lines(spark, sf_dir)).select(
        "record_pos", "case_id", "unit_id", "has_email", "confidence", "declared_size",
        F.array_join("true_members", ">").alias("true_list"),
        F.array_join("pred", ">").alias("pred_list"), F.col("email.subject").alias("subject"),
    ), "confidence")
