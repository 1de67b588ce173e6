import json

import pytest

from caseweave.plans import reports, scoring

SCHEMA = (
    "record_pos int, unit_id string, case_id string, has_email boolean, "
    "true_members array<string>, pred array<string>, confidence double, declared_size long"
)


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame([
        (0, "u1", "c0", True, ["a", "b"], ["a", "b"], 0.5, 2),
        (1, "u1", "c1", True, ["a", "b"], ["b"], None, 3),
        (2, "u2", "c2", True, ["a"], [], 0.1, 0),
        (3, "u2", "c3", False, ["a"], ["a"], 0.9, 1),
        (4, None, None, True, ["a", "c"], None, 0.9, None),
    ], SCHEMA)


def test_placeholders_are_counted_but_not_scored(records):
    assert scoring.run_counts(records).first().asDict() == {"n_records": 5, "n_scored": 4}
    assert scoring.score(records).count() == 4


def test_size_falls_back_to_the_length(records):
    sizes = {r.record_pos: r["size"] for r in scoring.score(records).collect()}
    assert sizes == {0: 2, 1: 3, 2: 1, 4: 2}


def test_summary_has_one_row_per_bucket(records):
    got = {
        (r.scope, r["size"], r.unit_id): r
        for r in scoring.summary(scoring.score(records)).collect()
    }
    assert got["overall", None, None].n == 4 and got["overall", None, None].exact_rate == 0.25
    unit = got["unit", None, "u1"]
    assert unit.n == 2 and unit.first_size == 2
    assert unit.normalized_edit_distance == 0.25 and unit.normalized_edit_distance_std == 0.25
    assert got["unit", None, "u2"].multiset_f1_std == 0.0
    assert got["size", 3, None].n == 1


def test_confusion(records):
    cells = scoring.confusion_cells(scoring.score(records))
    total = {(r.true_label, r.pred_label): r.n for r in scoring.overall_cells(cells).collect()}
    assert total == {
        ("a", "a"): 1, ("b", "b"): 2, ("a", "__delete__"): 3, ("c", "__delete__"): 1,
    }
    dense = scoring.dense_matrix(scoring.overall_cells(cells))
    assert dense.count() == 25
    assert scoring.dense_matrix(scoring.overall_cells(cells).limit(0)).count() == 4
    sized = scoring.dense_matrix(cells, ("size",))
    assert {r["size"]: r["count"] for r in sized.groupBy("size").count().collect()} == {
        1: 9, 2: 25, 3: 16,
    }
    wide = scoring.matrix_table(scoring.overall_cells(cells))
    assert wide.columns == ["true_label", "a", "b", "c", "__delete__"]
    row = scoring.confusion_totals(cells, []).first()
    assert (row.n_match, row.n_sub, row.n_ins, row.n_del) == (3, 0, 0, 4)


def test_the_matrix_as_lines_has_no_limit_of_labels(spark, records):
    cells = scoring.overall_cells(scoring.confusion_cells(scoring.score(records)))

    def lines(of):
        return [r.line for r in reports.matrix_lines(of).orderBy("place", "first").collect()]

    assert lines(cells) == [
        "true_label,a,b,c,__delete__", "a,1,0,0,3", "b,0,2,0,0", "c,0,0,0,1", "__insert__,0,0,0,0",
    ]
    assert lines(cells.limit(0)) == ["true_label,__delete__", "__insert__,0"]
    odd = spark.createDataFrame([('x,"y"', "z", 4)], "true_label string, pred_label string, n long")
    assert lines(odd) == [
        'true_label,"x,""y""",z,__delete__', '"x,""y""",0,4,0', "z,0,0,0", "__insert__,0,0,0",
    ]
    names = [f"l{i:04d}" for i in range(700)]
    many = spark.createDataFrame([(a, a, 1) for a in names], "true_label string, pred_label string, n long")
    got = lines(many)
    assert len(got) == 702 and got[0] == ",".join(["true_label", *names, "__delete__"])
    assert got[5] == ",".join(["l0004", *("1" if i == 4 else "0" for i in range(700)), "0"])


def test_a_sentinel_as_activity_is_refused(spark):
    bad = spark.createDataFrame([(0, "u", "c", True, ["__insert__"], ["a"], 0.0, 1)], SCHEMA)
    with pytest.raises(Exception, match="sentinel"):
        scoring.score(bad).collect()


def test_export_rounds_the_binary_value(spark):
    df = spark.createDataFrame([(0.03125,), (0.12345,), (-0.0625,)], "x double")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(reports.exported(F.col("x"))).collect()] == [
        round(0.03125, 4), round(0.12345, 4), round(-0.0625, 4)
    ]


def test_summary_json_lists_categories_most_common_first(records):
    scored = scoring.score(records)
    lines = reports.summary_json(
        scoring.run_counts(records), scoring.summary(scored), scoring.category_mix(scored),
        scoring.confusion_totals(scoring.confusion_cells(scored), ["size"]),
    ).collect()
    overall = next(r.line for r in lines if r.scope == "overall")
    assert '"categories":{"under-generation":3,"exact":1}' in overall
    assert any(r.scope == "config" for r in lines)


def test_summary_as_one_document(spark, records, tmp_path):
    more = spark.createDataFrame(
        [(9, 'u "x"', "c9", True, ["a", 'b"', "b"], ["b", "é", "b", "b"], 0.2, 3)], SCHEMA
    )
    scored = scoring.score(records.union(more))
    cells = scoring.confusion_cells(scored)
    document = reports.summary_document(
        scoring.run_counts(records.union(more)), scoring.summary(scored), scoring.category_mix(scored), cells
    )
    reports.write_document(document, str(tmp_path / "summary"))
    parts = sorted((tmp_path / "summary").glob("part-*"))
    got = json.loads("".join(p.read_text() for p in parts))
    assert list(got) == ["config", "overall", "by_size", "by_unit", "confusion"]
    assert got["config"] == {"n_records": 6, "n_scored": 5}
    assert got["overall"]["n"] == 5 and sum(got["overall"]["categories"].values()) == 5
    assert list(got["by_size"]) == ["1", "2", "3"] and set(got["by_unit"]) == {"", "u1", "u2", 'u "x"'}
    assert got["by_unit"]["u1"]["size"] == 2 and got["by_unit"]["u1"]["normalized_edit_distance"] == 0.25
    by_size = {r["size"]: {} for r in cells.collect()}
    for r in cells.collect():
        by_size[r["size"]][r.true_label, r.pred_label] = r.n
    everything = {}
    for found in by_size.values():
        for pair, n in found.items():
            everything[pair] = everything.get(pair, 0) + n
    assert set(got["confusion"]["by_size"]) == {"1", "2", "3"}
    for report, want in [
        (got["confusion"], everything), *((got["confusion"]["by_size"][str(k)], v) for k, v in by_size.items())
    ]:
        seen = {x for pair in want for x in pair} - {"__insert__", "__delete__"}
        labels = report["labels"]
        assert labels == sorted(seen) + ["__insert__", "__delete__"]
        assert report["matrix"] == [[want.get((a, b), 0) for b in labels] for a in labels]
        assert report["n_aligned"] == sum(want.values())
        subs = [[a, b, n] for (a, b), n in want.items() if a != b and a != "__insert__" and b != "__delete__"]
        assert report["substitutions"] == sorted(subs, key=lambda x: (-x[2], x[0], x[1]))


def test_rounding_is_that_of_the_binary_value(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(4)
    values = [0.03125, 0.12345, -0.00001, 0.5, 2.675, None, 1e6 + 0.00005] + [rng.random() for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = df.select("i", reports.exported(F.col("x")).alias("r"), reports.cell("x").alias("t")).orderBy("i").collect()
    want = [None if v is None else round(round(v, 12), 4) for v in values]
    assert [r.r for r in got] == want
    assert [r.t for r in got] == [None if w is None else f"{w:.3f}" for w in want]
