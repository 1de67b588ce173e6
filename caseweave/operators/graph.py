"""Node table, adjacency and application lookup of a case graph.

A *raw* node table has ``node_id, pos, labels, props, text_vec, struct_vec``;
:func:`node_table` adds what the later jobs ask about a node. Walk tables carry
flags instead of labels, so vectors and properties never travel with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.fixed import (
    ACTOR, BOUNDARY_LABELS, CASE, CASE_ID_KEYS, CASE_LINK_LABELS, CLUSTER, DECISION,
    HELPER_LABELS, LEAKY_LABELS, RATIONALE,
)
from caseweave.functions.text import span_index


#: Edges of one node that one task collapses.
HOT_EDGES = 1_000_000
#: Counters among which nodes are dealt to see whether one has more.
COUNTERS = 65_536


def real_labels(labels: Column) -> Column:
    """Labels without the helper ones; order and duplicates stay."""
    return F.filter(labels, lambda x: ~x.isin(*HELPER_LABELS))


def _has_any(labels: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(labels, F.array(*[F.lit(w) for w in wanted]))


def _prop(key: str) -> Column:
    # by index, which the planner looks up in a map that is being built
    return _filled(F.col("props")[key])


def _filled(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def node_table(raw: DataFrame) -> DataFrame:
    """Add primary label, stable id, application id and the label flags."""
    labels = F.col("labels")
    is_case = F.array_contains(labels, CASE)
    # a step of its own, as an operand that is used twice would need the whole map
    read = {key: f"_{key}" for key in CASE_ID_KEYS}
    stable = F.coalesce(_filled(F.col(read["id"])), F.concat(F.lit("#"), F.col("node_id")))
    return raw.withColumns({name: F.col("props")[key] for key, name in read.items()}).withColumns({
        "label": F.coalesce(F.try_element_at(labels, F.lit(1)), F.lit("Node")),
        "stable_id": stable,
        "span": span_index(stable),
        # canonical application id; only case nodes have one
        "app_id": F.when(is_case, F.coalesce(*[_filled(F.col(name)) for name in read.values()])),
        "is_case": is_case,
        "is_cluster": F.array_contains(labels, CLUSTER),
        "is_actor": F.array_contains(labels, ACTOR),
        "is_ranked": _has_any(labels, [DECISION, RATIONALE]),
        "is_leaky": _has_any(labels, LEAKY_LABELS),
        "is_boundary": _has_any(labels, BOUNDARY_LABELS),
        "links_case": _has_any(labels, CASE_LINK_LABELS),
    }).drop(*read.values())


def adjacency(nodes: DataFrame, edges: DataFrame, hot_edges: int = HOT_EDGES) -> DataFrame:
    """Undirected neighbour pairs with the flags walks need at either end.

    Parallel edges collapse: a walk only asks whether two nodes touch. Each pair
    gets the flags of both ends once, in two equi-joins on a node id, so a node
    that ends most of the edges is split by adaptive skew handling; only then it
    is written both ways round. What travels of an end are its id and application
    and its flags as the bits of one number. Where no node has very many edges,
    pairs are dealt by their first end, collapse there and meet its flags without
    moving again.
    """
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    counter = F.pmod(F.xxhash64("a"), F.lit(COUNTERS)).alias("counter")
    largest, total = pairs.groupBy(counter).agg(F.count("*").alias("n")).agg(
        F.max("n"), F.sum("n")
    ).first()
    if (largest or 0) <= max(hot_edges, (total or 0) // 10_000):
        pairs = pairs.repartition("a")
    pairs = pairs.distinct()
    names = ["is_case", "is_cluster", "is_actor", "is_leaky", "is_boundary", "links_case"]
    # two bits a flag, as labels may be missing and a flag NULL
    bits = F.lit(0)
    for i, name in enumerate(names):
        bits = bits + F.when(F.col(name), 3 << 2 * i).when(~F.col(name), 1 << 2 * i).otherwise(0)
    flags = nodes.select("node_id", "app_id", bits.alias("bits"))

    def ends(side: str) -> DataFrame:
        return flags.select(
            F.col("node_id").alias(side), F.col("app_id").alias(f"{side}_app"),
            F.col("bits").alias(f"{side}_bits"),
        )

    def told(at: str, name: str) -> Column:
        two = F.shiftright(f"{at}_bits", 2 * names.index(name)).bitwiseAND(3)
        return F.when(two != 0, two == 3)

    def way(src: str, dst: str) -> Column:
        return F.struct(
            F.col(src).alias("src"), F.col(dst).alias("dst"),
            F.col(f"{src}_app").alias("src_app"), told(src, "is_case").alias("src_case"),
            told(src, "is_actor").alias("src_actor"), F.col(f"{dst}_app").alias("dst_app"),
            *[
                told(dst, f"is_{name}").alias(f"dst_{name}")
                for name in ("cluster", "actor", "leaky", "boundary")
            ],
            told(dst, "links_case").alias("dst_links_case"),
        )

    both = pairs.join(ends("a"), "a").join(ends("b"), "b")
    return both.select(F.inline(F.when(
        (F.col("a") == F.col("b")) & F.col("a_app").eqNullSafe(F.col("b_app"))
        & F.col("a_bits").eqNullSafe(F.col("b_bits")),
        F.array(way("a", "b")),
    ).otherwise(F.array(way("a", "b"), way("b", "a")))))


def _canonical(cases: DataFrame) -> DataFrame:
    return cases.where("node_id is not null").select(F.col("app_id").alias("asked"), "node_id")


def _aliases(cases: DataFrame) -> DataFrame:
    """(asked, node_id): the first case node of each id that is not its canonical one."""
    return (
        cases.select(
            "pos", "node_id", "app_id",
            F.explode(F.array_distinct(F.array_compact(
                F.array(*[_prop(k) for k in CASE_ID_KEYS])
            ))).alias("asked"),
        )
        .where("asked <> app_id")
        .groupBy("asked")
        .agg(F.min_by("node_id", "pos").alias("node_id"))
    )


def case_ids(nodes: DataFrame) -> DataFrame:
    """Every id an application answers to: (asked, node_id).

    A canonical id leads to all case nodes that carry it; any other id value to
    the first case node in file order that has it.
    """
    cases = nodes.where("app_id is not null")
    canonical = cases.select(F.col("app_id").alias("asked"), "node_id")
    # an id that is its case's canonical one would meet itself in the anti-join, so it is left out before
    aliases = _aliases(cases).join(canonical.select("asked"), "asked", "left_anti")
    return canonical.unionByName(aliases)


def resolve(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Requested application ids with their case nodes, as :func:`case_ids` has them; unknown ids drop out.

    Only requests that are no canonical id look among the others.
    """
    cases = nodes.where("app_id is not null")
    found = requests.join(_canonical(cases), "asked", "left")
    other = found.where("node_id is null").drop("node_id").join(_aliases(cases), "asked")
    return found.where("node_id is not null").unionByName(other)


def alias_fanout(nodes: DataFrame) -> DataFrame:
    """Ids shared by several case nodes: a lookup by one of them takes the first."""
    cases = nodes.where("app_id is not null").select(
        "node_id", "app_id",
        F.explode(F.array_distinct(F.array_compact(
            F.array(*[_prop(k) for k in CASE_ID_KEYS])
        ))).alias("alias"),
    )
    return (
        cases.groupBy("alias")
        .agg(F.count("*").alias("n_cases"), F.min("app_id").alias("min_app"))
        .where("n_cases > 1")
    )
