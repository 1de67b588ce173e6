import pytest
from conftest import CURRENT, SIBLING, UNRELATED, node, occurrence, rows, tie

from caseweave.functions import text
from caseweave.operators import graph, guards, render, similarity, walk
from caseweave import runtime
from caseweave.operators.links import IdGraph, WalkGraph, has, rank_of
from caseweave.plans.context import CaseGraph, similar_hits
from caseweave.runtime import materialise, work_area
from pyspark.sql import functions as F


@pytest.fixture
def three(spark, dump, three_occurrences):
    nodes, edges = dump(three_occurrences)
    return CaseGraph(nodes, edges)


def owned(g):
    return walk.owners(g)


def hits(spark, g, query_id, kind="DecisionNode", current=None, exclude=True):
    requests = spark.createDataFrame(
        [("q", kind, query_id, 5, current)],
        "request_id string, kind string, query_id string, k int, current_app string",
    )
    return similar_hits(g.nodes, owned(g), requests, exclude_same_case=exclude)


def apps(found):
    return [r.application_id for r in found.orderBy("rank").collect()]


def test_decisions_and_rationales_reach_their_case_through_the_cluster(three):
    assert rows(owned(three), "node_id", "app") == sorted(
        (f"{kind}{n}", app)
        for n, app in ((1, CURRENT), (2, SIBLING), (3, UNRELATED)) for kind in ("dec", "rat")
    )


def test_own_application_is_always_excluded(spark, three):
    assert apps(hits(spark, three, "dec_1", exclude=False)) == [SIBLING, UNRELATED]


def test_siblings_are_excluded_on_request(spark, three):
    assert apps(hits(spark, three, "dec_1")) == [UNRELATED]
    assert apps(hits(spark, three, "rat_1", kind="RationaleNode")) == [UNRELATED]


def test_a_chained_query_cannot_return_the_case_being_solved(spark, three):
    assert CURRENT in apps(hits(spark, three, "dec_3"))
    assert apps(hits(spark, three, "dec_3", current=CURRENT)) == []


def test_request_status(spark, three):
    pool = similarity.candidates(three.nodes, owned(three))
    requests = spark.createDataFrame(
        [("a", "DecisionNode", "dec_1"), ("b", "DecisionNode", "nope"), ("c", "DecisionNode", "dec_2")],
        "request_id string, kind string, query_id string",
    )
    found = spark.createDataFrame([("a", 1)], "request_id string, rank int")
    got = similarity.request_status(requests, pool, found)
    assert rows(got, "request_id", "status") == [
        ("a", "found"), ("b", "unknown_id"), ("c", "nothing_comparable")
    ]


def test_guards(spark):
    asked = spark.createDataFrame(
        [(CURRENT, CURRENT), (SIBLING, CURRENT), (UNRELATED, CURRENT), (SIBLING, None)],
        "application_id string, current_app string",
    )
    assert [r.verdict for r in guards.guard(asked).collect()] == [
        "refused_current", "refused_sibling", "allowed", "allowed"
    ]
    assert [r.verdict for r in guards.guard(asked, exclude_same_case=False).collect()] == [
        "refused_current", "allowed", "allowed", "allowed"
    ]


def test_an_alias_does_not_slip_past_the_guard(spark, dump):
    nodes, edges = dump([
        node("p1", "ProcessInstance", id="Application_1__x", external_system_id="application_1__x"),
        node("p2", "ProcessInstance", id="Application_1__y", external_system_id="application_1__y"),
    ])
    aliases = guards.graph_aliases(graph.node_table(nodes))
    asked = spark.createDataFrame(
        [("Application_1__x", "application_1__x"), ("Application_1__y", "application_1__x")],
        "application_id string, current_app string",
    )
    assert {r.verdict for r in guards.guard(asked).collect()} == {"allowed"}
    assert rows(guards.guard(asked, ids=aliases), "verdict") == [
        ("refused_current",), ("refused_sibling",)
    ]


def test_guarded_subgraph_requests(spark, three):
    asked = spark.createDataFrame(
        [(CURRENT, CURRENT), (SIBLING, CURRENT), (UNRELATED, CURRENT)],
        "application_id string, current_app string",
    )
    got = {r.application_id: r for r in three.answer_subgraph_requests(asked, 2).collect()}
    assert got[CURRENT].text is None and got[SIBLING].text is None
    assert got[UNRELATED].text.startswith(
        f"Context subgraph for application {UNRELATED} (<= 2 hop(s)):\nNode:\nAC1 ActivityCluster"
    )


def test_coverage(spark, three):
    records = spark.createDataFrame(
        [(CURRENT, None), (None, UNRELATED), ("nope", UNRELATED)], "graph_key string, case_id string"
    )
    assert guards.coverage(records, three.nodes).first().n_resolved == 2
    with pytest.raises(ValueError, match="resolves 2 of 3"):
        guards.check_coverage(records, three.nodes)
    guards.check_coverage(records, three.nodes, at_least=0.5)
    with pytest.raises(ValueError, match="0 of 0"):
        guards.check_coverage(records.limit(0), three.nodes)


def case_with_actor():
    return [
        node("e1", "EvidenceNode", id="ev_note7__s1", text="The draft went out."),
        node("ac1", "ActivityCluster", id="cluster_7"),
        node("p1", "ProcessInstance", id="app1", name="Permit request"),
        node("d1", "DecisionNode", name="Approve"),
        node("a1", "Actor", name="Mara Quist", actor_type="Clerk"),
        tie("ac1", "part_of", "p1"), tie("a1", "prepared", "ac1"), tie("a1", "completed", "ac1"),
        tie("a1", "produced_evidence", "e1"), tie("ac1", "produced", "e1"),
        tie("ac1", "has_decision", "d1"), tie("d1", "acted_on", "ac1"), tie("d1", "supported_by", "e1"),
    ]


def drawn(spark, dump, items, ids, mask=True, this_email=False):
    g = CaseGraph(*dump(items), mask)
    members = g.numbers(spark.createDataFrame([("k", i) for i in ids], "key string, node_id string"))
    lines = render.subgraph_lines(members, g.nodes, g.rendered, "key", this_email)
    return render.subgraph_text(lines, "key").first().text


def test_two_nodes_exact_text(spark, dump):
    items = [i for i in case_with_actor() if i.get("id") in ("e1", "d1") or i.get("label") == "supported_by"]
    assert drawn(spark, dump, items, ["e1", "d1"], this_email=True) == (
        'Node:\nE1 EvidenceNode("The draft went out.", this email, span=1)\n'
        "D1 DecisionNode(Approve)\n\nRelationships:\nD1 is supported_by E1"
    )


def test_masking_collapses_verbs_and_leaves_the_rest(spark, dump):
    ids = ["e1", "ac1", "p1", "d1", "a1"]
    masked = drawn(spark, dump, case_with_actor(), ids).split("Relationships:\n")[1].split("\n")
    plain = drawn(spark, dump, case_with_actor(), ids, mask=False)
    assert "AC1 ActivityCluster(no details)\nP1 ProcessInstance(Permit request)" in plain
    assert [x for x in masked if x.startswith("A1")] == [
        "A1 is linked_to AC1", "A1 is produced_evidence E1"
    ]
    verbs = plain.split("Relationships:\n")[1].split("\n")
    assert [x for x in verbs if x.startswith("A1")] == [
        "A1 is completed AC1", "A1 is prepared AC1", "A1 is produced_evidence E1"
    ]
    assert {x for x in verbs if not x.startswith("A1")} <= set(masked)


def test_walk_keeps_but_does_not_leave_boundaries(spark, dump):
    nodes, edges = dump(
        occurrence(1, "app_1", [1.0]) + occurrence(2, "app_2", [1.0]) + [
            node("act", "Actor", name="hub"), node("ev", "Event", name="leak"),
            tie("act", "ran", "cl1"), tie("act", "ran", "cl2"), tie("ev", "names", "cl1"),
        ]
    )
    g = CaseGraph(nodes, edges)
    asked = spark.createDataFrame([("app_1",)], "asked string")
    for hops in (2, 4):
        assert [n for _, n in rows(g.application_members(asked, hops), "asked", "node_id")] == [
            "act", "cl1", "dec1", "pi1", "rat1"
        ]
    with_events = g.application_members(asked, 1, keep_leaky=True)
    assert ("app_1", "ev") in rows(with_events, "asked", "node_id")
    # an actor is never a seed
    start = spark.createDataFrame([("k", "act")], "asked string, node_id string")
    assert walk.neighbourhood(g.numbers(start), g, 2).count() == 0


def test_numbers_carry_flags_and_hot_nodes_walk_the_same(spark, dump):
    nodes, edges = dump(
        occurrence(1, "app_1", [1.0]) + occurrence(2, "app_2", [1.0])
        + [node("v", "ValueNode"), tie("dec1", "about", "v"), tie("dec2", "about", "v"),
           tie("rat1", "about", "v"), tie("rat2", "about", "v"), tie("v", "about", "v")]
    )
    asked = spark.createDataFrame([("app_1",), ("app_2",)], "asked string")
    found = []
    for limit in (100, 2):
        g = WalkGraph(nodes, edges, hot_links=limit)
        flagged = g.nodes.where(has("node", "is_case") != F.col("is_case"))
        assert flagged.count() == 0 and g.edges.columns == ["src", "rel", "dst"]
        assert (g.hot is None) == (limit == 100)
        if g.hot is not None:
            assert ("v",) in rows(g.names(g.hot), "node_id")
        seeds = walk.case_seeds(g.case_numbers(graph.resolve(asked, g.nodes)), g)
        found.append((
            rows(g.names(walk.neighbourhood(seeds, g, 3)), "asked", "node_id"),
            rows(walk.owners(g), "node_id", "app"),
        ))
    assert found[0] == found[1] and ("app_1", "dec2") in found[0][0]


def _walked(spark, g, hops, keep_leaky):
    asked = spark.createDataFrame([("app_1",), ("app_2",), ("nope",)], "asked string")
    seeds = walk.case_seeds(g.case_numbers(graph.resolve(asked, g.nodes)), g)
    members = walk.neighbourhood(seeds, g, hops, keep_leaky=keep_leaky)
    return (
        rows(g.names(members), "asked", "node_id"),
        rows(walk.seed_ids(members, g), "asked", "kind", "stable_id"),
    )


@pytest.mark.parametrize("limit, hops, keep", [(100, 2, False), (2, 1, True)])
def test_walks_over_hashed_ids_are_those_over_numbers(spark, dump, limit, hops, keep):
    """Ends that are no nodes, leaky seeds and inner nodes, parallel edges, loops and nodes listed twice."""
    raw, edges = dump(
        occurrence(1, "app_1", [1.0]) + occurrence(2, "app_2", [1.0]) + [
            node("v", "ValueNode"), node("act", "Actor"), node("ev", "Event"), node("leaf", "EvidenceNode"),
            node("far", "EvidenceNode", id="ev_far"), node("cl3", "ActivityCluster"),
            tie("dec1", "about", "v"), tie("dec2", "about", "v"), tie("rat1", "about", "v"), tie("v", "about", "v"),
            tie("act", "ran", "cl1"), tie("act", "ran", "cl2"), tie("act", "ran", "cl1"), tie("act", "saw", "rat1"),
            tie("ev", "names", "cl1"), tie("ev", "names", "far"), tie("cl1", "produced", "leaf"),
            tie("leaf", "near", "cl3"), tie("cl3", "part_of", "pi2"), tie("cl3", "produced", "leaf"),
        ]
    )
    missing = spark.createDataFrame([("dec1", "r", "gone"), ("gone", "r", "far"), (None, "r", "far")], edges.schema)
    twice = raw.unionByName(raw.where("node_id in ('v', 'pi1', 'leaf')"))
    # read more than once
    twice, every = materialise(twice, "raw"), materialise(edges.unionByName(missing), "every")
    plain, hashed = WalkGraph(twice, every, hot_links=limit), IdGraph(twice, every, hot_links=limit)
    assert (hashed.hot is None) == (limit == 100)
    want = _walked(spark, plain, hops, keep)
    assert _walked(spark, hashed, hops, keep) == want and want[0]


def test_a_walk_to_names_writes_no_tables(spark, tmp_path):
    """Links and nodes move once for all hops; before, nodes, edges, links and levels were written."""
    import pandas as pd

    from caseweave.checks.queries import QUERIES

    keys = pd.DataFrame({"k": range(1, 9)})
    some = {
        "orders": keys.assign(o_orderkey=keys.k, o_custkey=keys.k % 3, o_orderstatus="F", o_orderpriority="1"),
        "lineitem": keys.assign(l_orderkey=keys.k, l_linenumber=1, l_partkey=keys.k % 2, l_suppkey=keys.k % 2,
                                l_returnflag="R", l_linestatus="O"),
        "supplier": keys.assign(s_suppkey=keys.k - 1, s_name="s"), "part": keys.assign(p_partkey=keys.k - 1, p_name="p"),
    }
    for name, table in some.items():
        if "l_linenumber" in table:
            table = table.astype({"l_linenumber": "int32"})
        table.drop(columns="k").to_parquet(tmp_path / f"{name}.parquet")
    for name, n in {"case_neighbourhood_2": 8 * 7, "case_seed_ids": 8 * 3}.items():
        with work_area(spark):
            assert QUERIES[name](spark, str(tmp_path)).count() == n
            assert {p.rsplit("/", 1)[1].split("-")[0] for p in runtime._AREAS[-1]} <= {"counters", "hot"}


def test_two_ids_of_one_hash_are_told(spark, dump, monkeypatch):
    monkeypatch.setattr(IdGraph, "_hash", lambda self, name: F.length(name).cast("long"))
    g = IdGraph(*dump(occurrence(1, "app_1", [1.0])))
    with pytest.raises(Exception, match="two node ids of one hash"):
        g.names(g.nodes.select("node")).collect()


def test_adjacency_is_the_same_however_pairs_are_dealt(spark, dump):
    nodes, edges = dump(occurrence(1, "app_1", [1.0]) + [
        tie("dec1", "a", "rat1"), tie("rat1", "b", "dec1"), tie("dec1", "about", "dec1"),
    ])
    table = graph.node_table(nodes)
    dealt, plain = (graph.adjacency(table, edges, hot_edges=n) for n in (1_000_000, 0))
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect()))
    assert [tuple(r) for r in dealt.where("src = 'dec1' and dst = 'dec1'").collect()] == [
        ("dec1", "dec1", None, False, False, None, False, False, False, False, True)
    ]

    def moves(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression")

    assert (moves(dealt), moves(plain)) == (1, 0)


def test_owner_is_the_smallest_and_not_the_node_itself(spark, dump):
    both = node("x", "ProcessInstance", id="app_0")
    both["labels"].append("DecisionNode")
    nodes, edges = dump(
        occurrence(1, "app_1", [1.0]) + occurrence(2, "app_2", [1.0])
        + [both, node("v", "ValueNode"), tie("dec1", "about", "v"), tie("dec2", "about", "v"),
           tie("x", "about", "dec2")]
    )
    g = CaseGraph(nodes, edges)
    got = dict(rows(owned(g), "node_id", "app"))
    # dec2 touches case node x directly; dec1 is a walk of dec1-v-dec2-x away from it
    assert got["dec2"] == "app_0" and got["dec1"] == "app_0"
    # x itself must not count; app_2 is x-dec2-cl2-pi2 away and app_1 five hops
    assert got["x"] == "app_2"


def test_first_case_of_a_shared_name_and_all_of_a_shared_id(spark, dump):
    nodes, _ = dump([
        node("b", "ProcessInstance", external_system_id="app", name="Loan"),
        node("a", "ProcessInstance", external_system_id="app", name="Loan"),
        node("c", "ProcessInstance", external_system_id="other", name="Loan"),
        node("d", "ProcessInstance", name=""),
    ])
    assert rows(graph.case_ids(graph.node_table(nodes)), "asked", "node_id") == [
        ("Loan", "b"), ("app", "a"), ("app", "b"), ("other", "c")
    ]


def test_bare_cases_are_dropped(spark, dump):
    nodes, edges = dump([
        node("p1", "ProcessInstance", id="a"), node("p2", "ProcessInstance", id="b"),
        node("c1", "ActivityCluster"), node("v", "ValueNode"),
        tie("c1", "part_of", "p1"), tie("p2", "has", "v"),
    ])
    g = CaseGraph(nodes, edges)
    members = spark.createDataFrame(
        [("k", n) for n in ("p1", "p2", "c1", "v")] + [("m", "p1"), ("m", "v")],
        "asked string, node_id string",
    )
    kept = walk.without_bare_cases(materialise(g.numbers(members), "sets"), g)
    assert rows(g.names(kept), "asked", "node_id") == [("k", "c1"), ("k", "p1"), ("k", "v"), ("m", "v")]


def test_a_case_stays_whichever_of_its_neighbours_is_in_the_set(spark, dump):
    nodes, edges = dump([
        node("p1", "ProcessInstance", id="a"), node("c1", "ActivityCluster"), node("c2", "ActivityCluster"),
        tie("c1", "part_of", "p1"), tie("c2", "part_of", "p1"),
    ])
    g = CaseGraph(nodes, edges)
    sets = {"one": ["p1", "c1"], "other": ["p1", "c2"], "both": ["p1", "c1", "c2"], "none": ["p1"]}
    members = spark.createDataFrame(
        [(k, n) for k, held in sets.items() for n in held], "asked string, node_id string"
    )
    kept = walk.without_bare_cases(materialise(g.numbers(members), "sets"), g)
    assert [k for k, n in rows(g.names(kept), "asked", "node_id") if n == "p1"] == ["both", "one", "other"]


def test_numbers_sort_as_nodes_are_drawn_and_a_text_is_dealt_once(spark, dump):
    items = [node(f"e{i}", "EvidenceNode", id=f"ev__s{s}") for i, s in ((1, 10), (2, 9), (10, 9), (3, 1))]
    g = CaseGraph(*dump(items + [node("d1", "DecisionNode"), node("o", "Other")]))
    drawn_as = [r.node_id for r in g.nodes.where(rank_of("node") == 0).orderBy("node").collect()]
    assert drawn_as == ["e3", "e10", "e2", "e1"]
    assert rows(g.nodes.where("label <> 'EvidenceNode'").select("node_id", rank_of("node").alias("r")), "node_id", "r") == [
        ("d1", 4), ("o", 8)
    ]
    lines = spark.createDataFrame(
        [("k", 0, 0, 1, "a")], "key string, section int, rank int, n long, line string"
    )
    plan = render.subgraph_text(lines, "key")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_drawing_says_what_the_text_functions_say(spark):
    kinds = {"EvidenceNode": 0, "RationaleNode": 1, "DecisionNode": 2}
    props = [{}, {"text": " \u00a0"}, {"name": "", "text": "a" * 4001}, {"name": " n ", "confidence": "1"}]
    nodes = spark.createDataFrame(
        [([k], k, p, s) for k in kinds for p in props for s in (0, 3)] + [([None], "Node", None, 0)],
        "labels array<string>, label string, props map<string,string>, span long",
    )
    text_of, place = F.col("props"), (F.lit(False), F.col("span"))
    said = render.drawing(nodes).withColumns({
        "e": text.evidence_details(text_of, *place), "r": text.quoted_text(text_of), "d": text.format_props(text_of),
        "own": text.evidence_details(text_of, F.lit(True), F.col("span")),
    }).collect()
    assert len(said) == 25
    for x in said:
        details = (x.e, x.r, x.d)[kinds.get(x.label, 2)]
        assert x.shown == f" {x.label}({details})"
        assert x.shown_own == (f" {x.label}({x.own})" if x.label == "EvidenceNode" else None)


def test_similar_text(spark, three):
    found = hits(spark, three, "dec_1")
    text = three.similar_texts(found, "decision", 0.5, hops=1).first().text
    assert text == (
        "Top 1 decisions similar to dec_1 (hybrid score = 0.50*semantic + 0.50*structural):\n\n"
        f"1. [dec_3] score=0.600 (semantic=0.600, structural=0.600) application={UNRELATED}\n"
        '   text: "draft came back"\n   neighborhood (<= 1 hop(s)):\n   Node:\n'
        "   AC1 ActivityCluster(no details)\n"
        '   D1 DecisionNode("draft came back")\n   R1 RationaleNode("papers under review")\n   \n'
        "   Relationships:\n   AC1 is has_decision D1\n   D1 is justified_by R1"
    )


def test_seed_lists(spark, three):
    asked = spark.createDataFrame([(CURRENT,)], "asked string")
    row = three.seed_lists(asked, 2).first()
    assert (row.decisions, row.rationales, row.evidence) == ("dec_1", "rat_1", "")


def test_alias_fanout(three):
    assert rows(graph.alias_fanout(three.nodes), "alias", "n_cases") == [("Permit", 3)]


def _bipartite(spark):
    """Sets that share hubs at either end of their edges, in more of them than FEW_SETS and in fewer."""
    members = [(f"k{i}", n) for i in range(6) for n in (1, 2, 10 + i)] + [("k0", 20), ("k1", 20)]
    edges = [(1, "r", 2), (1, "s", 2), (2, "r", 1), (1, "r", 13), (14, "r", 2), (10, "r", 20), (20, "r", 11),
             (10, "r", 11), (1, "r", 99), (99, "r", 1), (1, "r", 1)]
    held = {}
    for k, n in members:
        held.setdefault(k, set()).add(n)
    want = sorted((k, s, r, d) for k, ns in held.items() for s, r, d in edges if s in ns and d in ns)
    return (
        spark.createDataFrame([(k, n, f"n{n}") for k, n in members], "asked string, node long, name string"),
        spark.createDataFrame(edges + edges[:3], "src long, rel string, dst long"), want,
    )


@pytest.mark.parametrize("few", [0, 2, 100])
def test_edges_of_sets_are_the_same_wherever_they_are_looked_up(spark, monkeypatch, few):
    monkeypatch.setattr(walk, "FEW_SETS", few)
    members, edges, want = _bipartite(spark)
    assert rows(walk.induced_edges(members, edges), "asked", "src", "rel", "dst") == want
    tagged = walk.induced_edges(members, edges, tag="name")
    assert rows(tagged, "asked", "src_tag", "rel", "dst_tag") == sorted((k, f"n{s}", r, f"n{d}") for k, s, r, d in want)


def _few_orders(tmp_path, n=8):
    import pandas as pd

    keys = pd.DataFrame({"k": range(1, n + 1)})
    some = {
        "orders": keys.assign(o_orderkey=keys.k, o_custkey=keys.k % 3, o_orderstatus="F", o_orderpriority="1",
                              o_orderdate=pd.Timestamp("2020-01-01")),
        "lineitem": keys.assign(l_orderkey=keys.k, l_linenumber=1, l_partkey=keys.k % 2, l_suppkey=keys.k % 2,
                                l_returnflag="R", l_linestatus="O").astype({"l_linenumber": "int32"}),
        "supplier": keys.assign(s_suppkey=keys.k - 1, s_name="s"), "part": keys.assign(p_partkey=keys.k - 1, p_name="p"),
    }
    for name, table in some.items():
        table.drop(columns="k").to_parquet(tmp_path / f"{name}.parquet", coerce_timestamps="us")
    return str(tmp_path)


@pytest.mark.parametrize("name, n, written", [
    ("induced_edges", 8 * 7, {"members"}),
    ("masked_edges", 8 * 8, set()),
])
def test_queries_over_hashed_ids_write_few_tables(spark, tmp_path, name, n, written):
    """Before, nodes, edges and links were numbered and written."""
    from caseweave.checks.queries import QUERIES

    with work_area(spark):
        assert QUERIES[name](spark, _few_orders(tmp_path)).count() == n
        assert {p.rsplit("/", 1)[1].split("-")[0] for p in runtime._AREAS[-1]} <= {"counters", "hot"} | written


def test_masking_over_hashed_ids_is_that_over_numbers(spark, dump):
    """Clusters at either end or none, parallel edges that become one, ends that are no nodes, nodes listed twice."""
    raw, edges = dump(case_with_actor() + [
        tie("ac1", "ran", "a1"), tie("a1", "ran", "d1"), tie("a1", "reviewed", "ac1"), tie("a1", "linked_to", "ac1"),
    ])
    gone = spark.createDataFrame([("gone", "ran", "ac1"), ("ac1", "ran", "gone")], edges.schema)
    twice = materialise(raw.unionByName(raw.where("node_id = 'a1'")), "raw")
    every = materialise(edges.unionByName(gone), "every")
    found = []
    for g in (WalkGraph(twice, every), IdGraph(twice, every), IdGraph(twice, every, hot_links=1)):
        for mask in (True, False):
            named = render.masked_edges(g.edges, mask, graph=g if isinstance(g, IdGraph) else None)
            for side in ("src", "dst"):
                named = g.names(named.withColumnRenamed(side, "node")).withColumnRenamed("node_id", side)
            found.append(rows(named, "src", "rel", "dst"))
    assert found[0] == found[2] == found[4] and found[1] == found[3] == found[5]
    assert ("a1", "linked_to", "ac1") in found[0] and ("a1", "ran", "d1") in found[0] and len(found[0]) < len(found[1])


def test_links_are_counted_by_the_pass_that_counts_edges(spark, dump):
    raw, edges = dump(occurrence(1, "app_1", [1.0]))
    made = spark.sparkContext.accumulator(0)

    def seen(value):
        made.add(1)
        return value

    counted = edges.withColumn("src", F.udf(seen).asNondeterministic()("src"))
    assert IdGraph(raw, counted).hot is None and made.value == edges.count() == 3


def test_a_stable_id_needs_no_other_property(spark, tmp_path):
    """Nor do nodes of one kind need those of another: before, all of a map and of an order's nodes were made."""
    from caseweave.checks import tables as T

    raw = T.graph_nodes(spark, _few_orders(tmp_path))

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    ids = graph.node_table(raw).select("node_id", "stable_id")
    assert "l_returnflag" in plan(raw) and "min(l_returnflag" not in plan(ids) and "map(" not in plan(ids)
    assert "l_orderkey" not in plan(graph.node_table(raw).where("is_actor"))
    assert ids.count() == 8 * 8


def test_texts_and_lists_of_one_request_share_a_walk(spark, three, monkeypatch):
    asked = spark.createDataFrame([(CURRENT,), (UNRELATED,)], "asked string")
    walked, plain = [], walk.neighbourhood
    monkeypatch.setattr(walk, "neighbourhood", lambda *a, **b: walked.append(a[2]) or plain(*a, **b))
    texts, lists = three.application_texts(asked, 2, this_email=True), three.seed_lists(asked, 2)
    assert walked == [2]
    assert {r.asked: r.decisions for r in lists.collect()} == {CURRENT: "dec_1", UNRELATED: "dec_3"}
    assert texts.where("status = 'ok'").count() == 2
    three.seed_lists(asked, 1)
    three.seed_lists(asked.where(f"asked = '{CURRENT}'"), 1)
    assert walked == [2, 1, 1]
