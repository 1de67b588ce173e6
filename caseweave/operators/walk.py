"""Bounded graph walks, for all cases at once, over the tables of :mod:`links`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.fixed import DECISION, EVIDENCE, OWNER_HOPS, RATIONALE
from caseweave.operators.links import IdGraph, WalkGraph, has
from caseweave.runtime import materialise

#: Sets a node may be in for its edges to be looked up from it without asking their other end.
FEW_SETS = 4


def _hop(graph: WalkGraph, frontier: DataFrame, links: DataFrame) -> DataFrame:
    """Frontier rows (.., node, salts) joined with the links of their nodes.

    Only the frontier is shuffled, to where the links of its nodes are.
    """
    placed = graph.spread(frontier.select("*", F.col("node").alias("src")), "node", "salts")
    return placed.dropDuplicates().drop("node", "salts").join(links, ["src", "salt"])


def case_seeds(resolved: DataFrame, graph: WalkGraph, key: str = "asked") -> DataFrame:
    """(key, node): case nodes of each application plus every cluster next to one of them."""
    if isinstance(graph, IdGraph):
        return graph.case_seeds(resolved, key)
    starts = graph.salted(resolved.select(key, "node"), "node", "salts")
    clusters = graph.links.where(has("src", "is_app") & has("dst", "is_cluster"))
    near = _hop(graph, starts, clusters.select("src", "salt", "dst")).select(
        key, F.col("dst").alias("node")
    )
    return _distinct(resolved.select(key, "node").unionByName(near), graph, key)


def _distinct(sets: DataFrame, graph: WalkGraph, key: str) -> DataFrame:
    """Each (key, node) once, dealt by node, so that a join by node that follows moves nothing again.

    Nodes with very many links may be in very many sets; these are dealt by set as well.
    """
    sets = sets.select(key, "node")

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("node").distinct()

    if graph.hot is None:
        return dealt(sets)
    hot = F.broadcast(graph.hot.select("node"))
    return dealt(sets.join(hot, "node", "left_anti").select(key, "node")).unionByName(
        sets.join(hot, "node", "left_semi").select(key, "node").distinct()
    )


def neighbourhood(
    seeds: DataFrame, graph: WalkGraph, hops: int, key: str = "asked", keep_leaky: bool = False
) -> DataFrame:
    """(key, node) within *hops* of the seeds (key, node).

    Cases, clusters and actors that are reached are kept but not walked through,
    which also takes the fan-out of hub actors out of every step. Seeds always
    spread, an actor is never a seed, and leaky nodes are left out.

    A hop writes what it reaches, feeds the nodes that are walked through to the
    next one, and the levels meet in one aggregation at the end. Nodes that end
    the walk are not shuffled by node at all, however many sets they are in. In an
    :class:`IdGraph` nothing is written, and every row moves to its node once.
    """
    if isinstance(graph, IdGraph):
        return graph.neighbourhood(seeds, hops, key, keep_leaky)
    links = graph.links if keep_leaky else graph.links.where(~has("dst", "is_leaky"))
    links = links.select("src", "salt", "dst", "dst_salts")
    starts = materialise(
        graph.salted(seeds.select(key, "node").where(~has("node", "is_actor")), "node", "salts"), "starts"
    )
    # a leaky seed spreads but is not shown
    shown = starts if keep_leaky else starts.where(~has("node", "is_leaky"))
    reached = shown.select(key, "node")
    frontier = starts.select(key, "node", "salts")
    for step in range(1, max(0, hops) + 1):
        level = _hop(graph, frontier, links).select(
            key, F.col("dst").alias("node"), F.col("dst_salts").alias("salts")
        )
        if step < hops:
            level = materialise(level, "level")
            frontier = level.where(~has("node", "is_boundary")).select(key, "node", "salts")
        reached = reached.unionByName(level.select(key, "node"))
    return _distinct(reached, graph, key)


def owners(graph: WalkGraph, hops: int = OWNER_HOPS) -> DataFrame:
    """Owning application of every decision and rationale: (node_id, app).

    The owner is the smallest application id among the case nodes within *hops*,
    walking through anything but actors and case nodes. Since only the smallest
    counts, each hop passes one code per node to its neighbours and keeps the
    minimum: (node, case) pairs never exist, and a node shared by very many
    cases costs no more than its edges. A hop shuffles the codes, pre-aggregated,
    to where the links of their nodes are, and nothing else.
    """
    if hops < 1:
        raise ValueError("an owner is at least one hop away")
    cases = graph.nodes.where("app_id is not null").join(graph.apps, "app_id").select("node", "app")
    links = graph.links.select(
        "src", "salt", "dst", "dst_salts",
        (~has("src", "is_app") & ~has("src", "is_actor")).alias("passes_on"),
    )

    def told(to: Column, salts: Column) -> Column:
        """One row per salt of the node that is told."""
        return F.when(salts == 1, F.array(F.struct(to.alias("node"), F.lit(0).alias("salt")))).otherwise(
            F.transform(
                F.sequence(F.lit(0), salts - 1), lambda s: F.struct(to.alias("node"), s.alias("salt"))
            )
        )

    def smallest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("node", "salt").agg(F.min("app").alias("app"))

    first = _hop(graph, graph.salted(cases, "node", "salts"), links)
    best = smallest(first.select("app", F.inline(told(F.col("dst"), F.col("dst_salts")))))
    for _ in range(1, hops):
        near = links.where("passes_on")
        met = best.join(near, (F.col("node") == near["src"]) & (best["salt"] == near["salt"]), "left")
        # what a node was told before stays; walks of fewer hops count as well
        kept = F.array(F.struct(F.col("node"), best["salt"].alias("salt")))
        on = F.when(F.col("dst").isNotNull(), told(F.col("dst"), F.col("dst_salts")))
        both = F.concat(kept, F.coalesce(on, F.filter(kept, lambda _: F.lit(False))))
        best = smallest(met.select("app", F.inline(both)))
    ranked = graph.nodes.where("is_ranked").select("node_id", "node", "app_id")
    found = best.where((F.col("salt") == 0) & has("node", "is_ranked")).select("node", "app")
    plain = found.join(ranked.where("app_id is null"), "node").select("node_id", "app")
    own = _owners_of_cases(graph, ranked.where("app_id is not null"), cases, hops)
    return (
        plain.unionByName(own).join(graph.apps, "app")
        .select("node_id", F.col("app_id").alias("app"))
    )


def _owners_of_cases(graph: WalkGraph, both: DataFrame, cases: DataFrame, hops: int) -> DataFrame:
    """(node_id, app) of decisions that are case nodes themselves and must not find themselves.

    The minimum cannot tell, so these few are walked one by one; a graph without
    any ends each join at once, its left side being empty.
    """
    links = graph.links.select(
        "src", "salt", "dst", "dst_salts",
        (has("dst", "is_app") | has("dst", "is_actor")).alias("stops"),
    )
    frontier = graph.salted(both.select("node_id", "node"), "node", "salts")
    reached = None
    for step in range(1, hops + 1):
        level = _hop(graph, frontier, links).select(
            "node_id", F.col("dst").alias("node"), F.col("dst_salts").alias("salts"), "stops"
        )
        if step < hops:
            level = materialise(level.distinct(), "level")
        found = level.select("node_id", "node")
        reached = found if reached is None else reached.unionByName(found)
        frontier = level.where("not stops").select("node_id", "node", "salts")
    itself = both.select("node_id", "node")
    return (
        reached.join(itself, ["node_id", "node"], "left_anti").join(cases, "node")
        .groupBy("node_id").agg(F.min("app").alias("app"))
    )


def without_bare_cases(members: DataFrame, graph: WalkGraph, key: str = "asked") -> DataFrame:
    """Drop case nodes no evidence, decision, rationale or cluster of the set (key, node) touches.

    Each case node is looked up with one neighbour of these kinds first. Only those whose
    neighbour is not in the set have all their links checked.
    """
    members = members.select(key, "node")
    touching = graph.links.where(has("src", "is_case") & has("dst", "links_case")).select(
        "src", F.lit("touches").alias("rel"), "dst"
    )
    one = touching.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("dst"))
    there = members.where(has("node", "links_case"))
    cases = materialise(
        members.where(has("node", "is_case")).join(one, "node").join(
            there.select(key, F.col("node").alias("dst"), F.lit(True).alias("seen")).distinct(),
            [key, "dst"], "left",
        ).select(key, "node", "seen"),
        "cases",
    )
    kept = members.where(~has("node", "is_case")).unionByName(cases.where("seen").select(key, "node"))
    rest = cases.where("seen IS NULL").select(key, "node")
    if rest.isEmpty():
        return kept
    near = there.unionByName(rest.where(~has("node", "links_case")))
    linked = induced_edges(near, touching, key).select(key, F.col("src").alias("node"))
    return kept.unionByName(rest.join(linked, [key, "node"], "left_semi"))


def induced_edges(
    members: DataFrame, edges: DataFrame, key: str = "asked", tag: str | None = None
) -> DataFrame:
    """Directed edges with both ends in the same set: (key, src, rel, dst).

    Each edge is looked up where it starts if that is in :data:`FEW_SETS` sets at most, else from
    the end that is in fewer sets. A hub that is in very many sets and has very many edges would
    otherwise pair every set with every edge before the second end is checked; only edges of
    such hubs go to their other end to compare. *members* should be a written table: it is read
    several times. With *tag*, a column of *members*, the ends' tags come along as ``src_tag``
    and ``dst_tag``.
    """
    spread = members.groupBy("node").agg(F.count("*").alias("n"))
    at_src = edges.distinct().join(spread.select(F.col("node").alias("src"), F.col("n").alias("n_src")), "src")
    few = F.col("n_src") <= FEW_SETS
    sized = at_src.where(~few).join(spread.select(F.col("node").alias("dst"), F.col("n").alias("n_dst")), "dst")
    from_src = F.col("n_src") <= F.col("n_dst")
    near, far = ([F.col(tag).alias(n)] if tag else [] for n in ("near_tag", "far_tag"))

    def looked_up(rows: DataFrame, side: str, other: str) -> DataFrame:
        return rows.select(F.col(side).alias("node"), "rel", F.col(other).alias("other")).join(
            members.select(key, "node", *near), "node"
        ).withColumn("from_src", F.lit(side == "src"))

    tied = (
        looked_up(at_src.where(few), "src", "dst")
        .unionByName(looked_up(sized.where(from_src), "src", "dst"))
        .unionByName(looked_up(sized.where(~from_src), "dst", "src"))
        .join(members.select(key, F.col("node").alias("other"), *far), [key, "other"])
    )

    def end(here: str, there: str) -> Column:
        return F.when(F.col("from_src"), F.col(here)).otherwise(F.col(there))

    return tied.select(
        key, end("node", "other").alias("src"), "rel", end("other", "node").alias("dst"),
        *([end("near_tag", "far_tag").alias("src_tag"), end("far_tag", "near_tag").alias("dst_tag")] if tag else []),
    )


def seed_ids(members: DataFrame, graph: WalkGraph, key: str = "asked") -> DataFrame:
    """Decision, rationale and evidence ids of each set in long form."""
    kinds = {DECISION: "decisions", RATIONALE: "rationales", EVIDENCE: "evidence"}
    # a kind travels as a number; ids that sort together take less when they are written
    place = F.coalesce(*[F.when(F.col("label") == k, i) for i, k in enumerate(kinds, 1)])
    kept = graph.nodes.select("node", place.alias("place"), "stable_id").where("place is not null")
    kind = F.element_at(F.array(*map(F.lit, kinds.values())), F.col("place"))
    return members.join(kept, "node").select(key, kind.alias("kind"), "stable_id").sortWithinPartitions("stable_id")
