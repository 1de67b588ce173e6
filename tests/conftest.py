import json

import pytest

from caseweave.runtime import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, shuffle_partitions=4, folder=str(tmp_path_factory.mktemp("work")))
    yield session
    session.stop()


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def node(node_id, label, **props):
    return {"type": "node", "id": node_id, "labels": [label], "properties": props}


def tie(start, label, end):
    return {"type": "relationship", "label": label, "start": {"id": start}, "end": {"id": end}}


def occurrence(n, app, vector):
    """One case: case node <- cluster -> decision -> rationale."""
    vectors = {"text_embedding": vector, "fastrp_embedding": vector}
    return [
        node(f"pi{n}", "ProcessInstance", id=app, external_system_id=app, name="Permit"),
        node(f"cl{n}", "ActivityCluster", id=f"cluster_{app}"),
        node(f"dec{n}", "DecisionNode", id=f"dec_{n}", text="draft came back", **vectors),
        node(f"rat{n}", "RationaleNode", id=f"rat_{n}", text="papers under review", **vectors),
        tie(f"cl{n}", "part_of", f"pi{n}"),
        tie(f"cl{n}", "has_decision", f"dec{n}"),
        tie(f"dec{n}", "justified_by", f"rat{n}"),
    ]


CURRENT = "application_1__t1a"
SIBLING = "application_1__t2b"
UNRELATED = "application_2__t3c"


@pytest.fixture(scope="session")
def three_occurrences():
    """Two occurrences of one case with nearly equal vectors, and another case."""
    return (
        occurrence(1, CURRENT, [1.0, 0.0, 0.0])
        + occurrence(2, SIBLING, [0.99, 0.1, 0.0])
        + occurrence(3, UNRELATED, [0.6, 0.8, 0.0])
    )


@pytest.fixture
def dump(spark, tmp_path):
    """Write items as a dump file and read it back as (raw nodes, edges)."""
    from caseweave.sources import graph_dump

    def load(items, extra=()):
        path = tmp_path / "graph.json"
        path.write_text("\n".join([json.dumps(i) for i in items] + list(extra)), encoding="utf-8")
        read = graph_dump.Dump(graph_dump.read_dump(spark, str(path)))
        return read.nodes, read.edges

    return load
