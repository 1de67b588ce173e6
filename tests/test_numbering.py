from caseweave.operators import timeline
from caseweave.operators.numbering import number_rows, text_parts, whole_text


def table(spark):
    """One group holds most of the rows."""
    rows = [("hot", f"{(i * 37) % 500:04d}") for i in range(500)]
    rows += [(f"g{i % 20}", f"{i:04d}") for i in range(60)]
    return spark.createDataFrame(rows, "g string, v string").repartition(4)


def test_hot_groups_get_the_numbers_a_window_gives(spark):
    df = table(spark)
    plain = {(r.g, r.v): r.n for r in number_rows(df, ["g"], ["v"]).collect()}
    spread = {(r.g, r.v): r.n for r in number_rows(df, ["g"], ["v"], hot_rows=40).collect()}
    assert spread == plain
    assert sorted(n for (g, _), n in spread.items() if g == "hot") == list(range(1, 501))


def test_parts_hold_the_whole_text(spark):
    lines = number_rows(table(spark), ["g"], ["v"]).withColumnRenamed("v", "line")
    parts = text_parts(lines, ["g"], [], part_lines=7)
    hot = parts.where("g = 'hot'").orderBy("part").collect()
    assert len(hot) == 72
    assert "\n".join(r.text for r in hot).split("\n") == [f"{i:04d}" for i in range(500)]
    texts = {r.g: r.text for r in whole_text(parts, ["g"], []).collect()}
    assert texts["hot"] == "\n".join(f"{i:04d}" for i in range(500))


def test_a_text_of_many_parts_is_whole(spark):
    lines = spark.range(1, 2002).selectExpr("'k' g", "id n", "concat('line ', id) line")
    text = whole_text(text_parts(lines, ["g"], [], 1), ["g"], []).first()
    assert text.n_parts == 2001
    assert text.text.split("\n") == [f"line {i}" for i in range(1, 2002)]


def test_a_long_log_is_answered_with_all_lines(spark):
    lines = spark.range(1, 2002).selectExpr("'k' graph_key", "id n", "concat('- ', id) line")
    logs = spark.createDataFrame([("k",), ("e",)], "graph_key string")
    texts = timeline.timeline_texts(logs, lines)
    asked = spark.createDataFrame([("k",), ("e",), ("x",)], "application_id string")
    keys = logs.selectExpr("graph_key application_id", "graph_key")
    got = {r.application_id: r for r in timeline.answer(asked, keys, texts).collect()}
    assert got["k"].status == "ok" and got["k"].text.endswith("\n- 2001")
    assert got["k"].text.count("\n- ") == 2001
    assert got["e"].status == "ok" and got["x"].status == "unknown_id"
