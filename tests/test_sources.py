import json

import pytest
from conftest import node, rows, tie

from caseweave.operators import graph, timeline
from caseweave.plans import predictions
from caseweave.sources import event_log, graph_dump, records


def test_node_lines_win_over_ends_and_the_last_one_wins(spark, dump):
    end = {"id": "n", "labels": ["__Entity__", "Actor"], "properties": {"name": "from end"}}
    only = {"id": "m", "labels": ["Actor"], "properties": {"name": "first"}}
    later = {"id": "m", "labels": ["Event"], "properties": {"name": "second"}}
    nodes, edges = dump([
        {"type": "relationship", "label": "x", "start": end, "end": only},
        node("n", "EvidenceNode", name={"type": "String", "value": "early"}),
        {"type": "node", "id": "n", "labels": [], "properties": {}},
        node("n", "DecisionNode", name="late", confidence=1.0, decision_type=True),
        {"type": "relationship", "type2": 1, "start": {"id": 7}, "end": later},
        {"type": "relationship", "label": "gone", "start": {"id": None}, "end": {"id": "n"}},
    ], extra=["{broken", "", '{"type":"node","id":"tail"} trailing', '{"type":"node","id":"ok"},'])
    table = graph.node_table(nodes)
    got = {r.node_id: r for r in table.collect()}
    assert set(got) == {"n", "m", "7", "ok"}
    assert got["n"].label == "DecisionNode"
    assert got["n"].props == {"name": "late", "confidence": "1.0", "decision_type": "True"}
    assert got["m"].label == "Actor" and got["m"].props == {"name": "first"}
    assert got["ok"].label == "Node" and got["ok"].stable_id == "#ok"
    assert rows(edges, "src", "rel", "dst") == [("7", "relationship", "m"), ("n", "x", "m")]


def test_rejected_lines_are_counted(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"type":"node","id":"a"}\n\n{"a\n[1,\n')
    read = graph_dump.Dump(graph_dump.read_dump(spark, str(tmp_path / "g.json")))
    assert (read.n_lines, read.n_rejected) == (3, 2)
    assert read.nodes.count() == 1 and read.edges.count() == 0


def test_place_in_the_dump_decides_over_files_and_splits(spark, tmp_path):
    """Two files in many splits, read in any order: the first end and the last node line win."""
    def lines(name):
        for i in range(300):
            end = {"id": f"n{i % 40}", "labels": ["Actor"], "properties": {"name": f"{name}{i}"}}
            yield tie(f"s{i}", "x", "t") | {"end": end}
            if i % 3 == 0:
                yield node(f"own{i % 6}", "Event", name=f"{name}{i}")
        yield tie("loop", "x", "loop") | {
            "start": {"id": "loop", "properties": {"name": "start"}},
            "end": {"id": "loop", "labels": ["Actor"], "properties": {"name": "end"}},
        }

    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text("\n".join(map(json.dumps, lines(name))))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        raw = graph_dump.read_dump(spark, str(tmp_path))
        assert raw.rdd.getNumPartitions() > 8
        got = {r.node_id: r for r in graph_dump.Dump(raw).nodes.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [got[f"n{i}"].props["name"] for i in range(40)] == [f"a{i}" for i in range(40)]
    assert got["own0"].props["name"] == "b294" and got["own3"].props["name"] == "b297"
    assert got["loop"].props["name"] == "start" and got["loop"].labels == ["Actor"]
    order = sorted((r.pos, n) for n, r in got.items() if n.startswith("s"))
    assert [n for _, n in order] == [f"s{i}" for i in range(300)]


def test_vectors_are_unwrapped_or_missing(spark, dump):
    typed = {"type": "List", "value": [{"type": "Double", "value": 0.5}, 1]}
    nodes, _ = dump([
        node("a", "DecisionNode", text_embedding=typed, fastrp_embedding=[1, 2.5]),
        node("b", "DecisionNode", text_embedding=[], fastrp_embedding=["x"]),
    ])
    assert rows(nodes, "node_id", "text_vec", "struct_vec") == [
        ("a", [0.5, 1.0], [1.0, 2.5]), ("b", None, None)
    ]


def write_records(path, items):
    path.write_text("\n".join(json.dumps(i, ensure_ascii=False) for i in items), encoding="utf-8")


def test_record_fields(spark, tmp_path):
    write_records(tmp_path / "r.jsonl", [
        {"case_id": "A", "graph_key": "a", "email": {"subject": "é"}, "true_members": ["x"],
         "gram_size": 0, "size": 9, "extra": {"k": [1]}, "pred": ["old"]},
        {"email": {}, "size": 4}, {"email": "", "gram_size": None, "size": 4}, {"email": None},
    ])
    lines = records.read_lines(spark, str(tmp_path / "r.jsonl"))
    got = records.parse_records(lines).orderBy("record_pos").collect()
    assert [r.has_email for r in got] == [True, False, False, False]
    # a present gram_size hides size, also when it is 0 or null
    assert [r.declared_size for r in got] == [0, 4, None, None]
    assert got[0].email.subject == "é" and got[0].true_members == ["x"]

    answers = spark.createDataFrame([], "x int").select()
    parsed = records.parse_records(lines)
    answers = parsed.where("case_id = 'A'").selectExpr("record_pos", "array('y') pred", "0.5D confidence")
    out = tmp_path / "out"
    records.write_lines(records.echo_lines(parsed, answers), str(out))
    back = [json.loads(x) for p in sorted(out.glob("part-*")) for x in p.read_text("utf-8").splitlines()]
    assert len(back) == 4 and back[0]["extra"] == {"k": [1]}
    assert back[0]["pred"] == ["y"] and back[0]["confidence"] == 0.5
    assert back[1]["pred"] == [] and back[1]["confidence"] == 0.0


def test_a_malformed_record_is_an_error(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n{"a"\n')
    with pytest.raises(Exception, match="MALFORMED"):
        records.parse_records(records.read_lines(spark, str(tmp_path / "r.jsonl"))).collect()


def test_input_fallback(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        records.resolve_input(spark, str(tmp_path), "generated")
    (tmp_path / "generated_b.jsonl").write_text("")
    (tmp_path / "generated_a.jsonl").write_text("")
    assert records.resolve_input(spark, str(tmp_path), "generated").endswith("generated_a.jsonl")
    (tmp_path / "generated.jsonl").write_text("")
    assert records.resolve_input(spark, str(tmp_path), "generated").endswith("generated.jsonl")


def test_catalog(spark, tmp_path):
    (tmp_path / "schema_x_only.json").write_text(json.dumps([
        {"event_type": "A_One", "description": "first"}, {"event_type": "a_one", "description": "again"},
    ], indent=1))
    path = records.resolve_catalog(spark, str(tmp_path), "x")
    catalog = records.Catalog(records.read_catalog(spark, path))
    assert catalog.text == "- A_One: first\n- a_one: again"
    assert catalog.canonical == {"a_one": "a_one"}


LOG = {"events": [
    {"type": "O_Sent", "time": "2016-02-02", "relationships": [{"objectId": "o1"}, {"objectId": ""}]},
    {"type": "internal_email_sent", "time": "2016-02-01", "attributes": [
        {"name": "EmailID", "value": "m1"}, {"name": "Subject", "value": "hi"},
        {"name": "Body", "value": "done"}, {"name": "true_members", "value": "SECRET"}]},
    {"type": "A_Start", "time": "2016-02-01", "relationships": []},
]}


def test_log_files_to_timelines(spark, tmp_path):
    for key, log in (("app_1", LOG), ("app 2", {"events": []})):
        (tmp_path / key).mkdir()
        (tmp_path / key / event_log.LOG_FILE).write_text(json.dumps(log, indent=1))
    logs = event_log.read_logs(spark, str(tmp_path))
    known = spark.createDataFrame(
        [(0, "App_1", "app_1"), (1, "App_1", "app 2"), (2, "App_2", "app 2"), (3, "App_3", "app_3")],
        "record_pos int, case_id string, graph_key string",
    )
    asked = spark.createDataFrame([(x,) for x in ("App_1", "app 2", "App_3", "zzz")], "application_id string")
    for use_email in (True, False):
        lines = timeline.timeline_lines(event_log.flatten(logs), use_email)
        texts = timeline.timeline_texts(logs, lines)
        got = {r.application_id: r for r in timeline.answer(asked, timeline.log_keys(known), texts).collect()}
        assert got["App_3"].status == "missing_file" and got["zzz"].status == "unknown_id"
        assert got["app 2"].text.endswith("Events (chronological):\n(no events)")
        subject, body = ("hi", "done") if use_email else ("[redacted]", "[redacted]")
        assert got["App_1"].text.split("Events (chronological):\n")[1] == (
            "- 2016-02-01 | internal_email_sent (HIDDEN activities are here)\n  EmailID=m1\n"
            f"  Subject: {subject}\n  Body: {body}\n"
            "- 2016-02-01 | A_Start\n- 2016-02-02 | O_Sent [objects: o1]"
        )
        assert "SECRET" not in got["App_1"].text


def test_predictions_onto_records(spark):
    base = spark.createDataFrame([(0, "a", 0.1), (1, "b", 0.2)], "record_pos int, x string, confidence double")
    found = spark.createDataFrame([(1, ["p"], 0.7)], "record_pos int, pred array<string>, confidence double")
    assert rows(predictions.onto_records(base, found), "record_pos", "x", "pred", "confidence") == [
        (0, "a", [], 0.0), (1, "b", ["p"], 0.7)
    ]


def test_lines_are_trimmed_alike_with_and_without_the_short_way(spark):
    from pyspark.sql import functions as F

    from caseweave.functions.text import strip
    from caseweave.sources.graph_dump import _trimmed

    ends = ["", ",", ",,", " ,", ", ", "\t", " ,", " "]
    texts = [a + body + b for body in ("{}", '{"a": "é"}', "{", "}", "", "x") for a in ("", " ", " ") for b in ends]
    df = spark.createDataFrame([(t,) for t in texts], "line string")
    long_way = strip(F.rtrim(strip(F.col("line")), F.lit(",")))
    assert df.where(~_trimmed().eqNullSafe(long_way)).count() == 0


def test_lines_do_not_move_to_their_splits(spark):
    from caseweave.sources.graph_dump import Dump

    lines = spark.createDataFrame(
        [((f"f{i % 3}", i % 2, i), '{"type": "node", "id": "n%d", "labels": ["A"]},' % i) for i in range(6)],
        "pos struct<file: string, block: long, row: long>, line string",
    )
    dump = Dump(lines)
    plan = dump._sightings()._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
    assert dump.nodes.count() == 6 and dump.n_rejected == 0


def test_a_comma_goes_without_counting_characters_and_plain_text_is_read_once(spark):
    from pyspark.sql import functions as F

    from caseweave.functions.variants import as_text, as_vector
    from caseweave.sources.graph_dump import _trimmed

    lines = spark.createDataFrame([('{"a": "é…"},',), ("{},",)], "line string")
    cut = lines.select(_trimmed().alias("t"))
    assert [r.t for r in cut.collect()] == ['{"a": "é…"}', "{}"]
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in plan and "char_length" not in plan.replace("octet_length", "") and "left(" not in plan
    values = spark.createDataFrame([(x,) for x in ('"1.0"', "1.0", "2", "true", "null", '"true"', "[0.5]", "[]")], "j string")
    value = F.parse_json("j")
    got = [(r.t, r.v) for r in values.select(as_text(value).alias("t"), as_vector(value).alias("v")).collect()]
    assert got == [("1.0", None), ("1.0", None), ("2", None), ("True", None), (None, None), ("true", None),
                   ("[0.5]", [0.5]), ("[]", None)]
    shown = values.select(as_text(value).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "STRING" in shown
