import pytest
from conftest import rows

from caseweave.functions import text
from caseweave.plans import predictions, prompts
from pyspark.sql import functions as F


class Catalog:
    text = "- P_Filed: a permit is filed\n- P_Granted: a permit is granted"
    canonical = {"p_filed": "P_Filed", "p_granted": "P_Granted"}


TIMELINE = (
    "OBSERVED CASE TIMELINE (offline): Events are given - use BOTH sides.\n\n"
    "- 2021-05-02 | P_Asked | objects: file9\n"
    ">>> THIS hidden email TO RECONSTRUCT (activities unknown) <<<\n"
    "- 2021-05-09 | P_Closed | objects: file9\n"
)
SCHEMA = (
    "record_pos int, graph_key string, case_id string, email_uid string, has_email boolean, "
    "email struct<subject: string, body: string, sender: string, objects: string>, "
    "observed_timeline string"
)


def records(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def one(spark, timeline=TIMELINE, mail=("Update", "Granted {{body}} today.", "mara", "file9| |x ")):
    return records(spark, (0, "k", None, "e1", mail is not None, mail, timeline))


def user(df, **options):
    return prompts.prompts(df, Catalog(), **options).first().user


def test_header_is_stripped(spark):
    got = spark.range(1).select(text.strip_timeline_header(F.lit(TIMELINE))).first()[0]
    assert got.startswith("- 2021-05-02 | P_Asked") and ">>> THIS hidden email" in got
    assert "use BOTH sides" not in got and got.endswith("file9")


def test_blocks_follow_the_arm(spark):
    both = user(one(spark))
    assert "=== EMAIL ===" in both and "=== OCEL CONTEXT" in both
    assert "Objects: file9, x\n" in both and "Granted {{body}} today." in both
    assert "=== EMAIL ===" not in user(one(spark), use_email=False)
    assert "=== OCEL CONTEXT" not in user(one(spark), use_timeline=False)
    assert "=== OCEL CONTEXT" not in user(one(spark, timeline=" \n"))
    assert "=== EMAIL ===" not in user(one(spark, mail=None))


def test_missing_timeline_raises_only_when_wanted(spark):
    with pytest.raises(Exception, match="missing observed_timeline"):
        user(one(spark, timeline=None))
    user(one(spark, timeline=None), use_timeline=False)


def test_cap_and_single(spark):
    assert "AT MOST 1 activity -" in user(one(spark), cap=1)
    assert "AT MOST 3 activities" in user(one(spark), cap=3)
    assert "AT MOST" not in user(one(spark), cap=3, single=True)


def test_equal_prompts_are_sent_once_and_failures_not_shared(spark):
    df = records(spark, *[(i, f"k{i}", None, None, True, ("s", "b", "x", "") if i < 3 else
                           ("other", "b", "x", ""), "") for i in range(5)])
    made = prompts.prompts(df, Catalog())
    sent = prompts.to_send(made)
    assert rows(sent, "record_pos", "n_records") == [(0, 3), (3, 2)]
    answers = sent.select(
        "prompt_key", F.lit("raw").alias("raw"),
        F.when(F.col("n_records") == 2, "no_json").alias("error"),
    )
    shared = prompts.share_answers(made, answers)
    assert rows(prompts.audit(df, made, shared), "record_pos", "folder", "status") == [
        (0, "k0", "ok"), (1, "k1", "cache-hit"), (2, "k2", "cache-hit"), (3, "k3", "failed"),
    ]


def test_graph_prompt(spark):
    df = records(spark, (0, "app", None, None, True, None, TIMELINE), (1, "", "none", None, True, None, ""),
                 (2, "huge", None, None, True, None, ""))
    texts = spark.createDataFrame(
        [("app", "ok", "THE GRAPH"), ("huge", "in_parts", None)],
        "asked string, status string, text string",
    )
    seeds = spark.createDataFrame([("app", "dec_1", "")], "asked string, decisions string, rationales string")
    got = prompts.graph_prompts(df, Catalog(), texts, seeds).orderBy("record_pos").collect()
    assert "THE GRAPH" in got[0].user and "- decisions: dec_1\n- rationales: (none)" in got[0].user
    assert "No application none is in the graph." in got[1].user and "OCEL CONTEXT" not in got[1].user
    assert got[2].user is None
    assert "linked_to" in got[0].system and "prepared" not in got[0].system
    plain = prompts.graph_prompts(df, Catalog(), texts, seeds, use_tools=False, mask=False).first()
    assert "Seed node ids" not in plain.user and "signed_off" in plain.system


ANSWERS = [
    ('{"activities": ["p_filed ", "P_Granted", "x", "P_GRANTED"], "confidence": "0.5"}', 3, 0.5, None),
    ('```json\n{"activities": "P_Filed", "confidence": null}\n```\nbye', 1, 0.0, None),
    ('Sure: {"activities": ["P_Filed"]} ok', 0, 0.0, "no_json"),
    ('["P_Filed"]', 0, 0.0, "not_an_object"),
    ('{"activities": null}', 0, 0.0, "bad_activities"),
    ('{"activities": ["P_Filed"], "confidence": "high"}', 0, 0.0, "bad_confidence"),
    ('{"confidence": 0.25}', 0, 0.25, None),
]


def parsed(spark, **options):
    df = spark.createDataFrame([(i, a[0]) for i, a in enumerate(ANSWERS)], "i int, raw string")
    return predictions.parse_responses(df, Catalog(), **options).orderBy("i").collect()


def test_plain_answers(spark):
    for (raw, n, confidence, error), r in zip(ANSWERS, parsed(spark)):
        assert (len(r.pred), r.confidence, r.error) == (n, confidence, error), raw
    assert parsed(spark)[0].pred == ["P_Filed", "P_Granted", "P_Granted"]
    assert parsed(spark, single=True)[0].pred == ["P_Filed"]
    assert parsed(spark, max_activities=2)[0].pred == ["P_Filed", "P_Granted"]


def test_agent_answers_are_read_leniently(spark):
    got = parsed(spark, agent=True)
    assert [r.error for r in got] == [None, None, None, "no_json", None, None, None]
    assert got[2].pred == ["P_Filed"] and got[5].confidence == 0.0 and got[5].pred == ["P_Filed"]


def test_catalogs_of_any_size(spark):
    entries = [(0, "P_filed", "an older spelling"), (1, "P_Filed", "a permit is filed"), (2, "P_Granted", "a permit is granted")]
    entries += [(i, f"X_{i}", "more") for i in range(3, 12_000)]
    catalog = spark.createDataFrame(entries, "pos int, event_type string, description string").repartition(5)
    df = spark.createDataFrame(
        [(i, a[0]) for i, a in enumerate(ANSWERS)] + [(99, '{"activities": ["x_11999", "y", " X_3 ", "x_11999"]}')] * 2,
        "i int, raw string",
    )
    for options in ({}, {"single": True}, {"max_activities": 2}, {"agent": True}):
        got = predictions.parse_responses(df, catalog, **options)
        assert got.columns == predictions.parse_responses(df, Catalog(), **options).columns
        got = got.orderBy("i").collect()
        assert [tuple(r) for r in got[:-2]] == [tuple(r) for r in parsed(spark, **options)]
        size = options.get("max_activities", 1 if "single" in options else 3)
        assert [r.pred for r in got[-2:]] == [["X_11999", "X_3", "X_11999"][:size]] * 2
    assert predictions.parse_responses(df, catalog.limit(0)).where("size(pred) > 0").count() == 0

    shown = prompts.prompts(one(spark), catalog.where("pos in (1, 2)")).first()
    want = prompts.prompts(one(spark), Catalog()).first()
    assert shown.user == want.user and shown.prompt_key == want.prompt_key
    whole = prompts.prompts(one(spark), catalog).first().user
    assert whole.count("\n- X_") == 11_997 and whole.index("- X_11998: more\n- X_11999: more\n\n") > 0


def test_failure_gate(spark):
    df = predictions.parse_responses(
        spark.createDataFrame([("x",), ('{"activities": []}',)], "raw string"), Catalog()
    )
    predictions.check_failures(df, 0.5)
    with pytest.raises(ValueError, match="1 of 2"):
        predictions.check_failures(df, 0.4)


def test_text_helpers(spark):
    row = spark.range(1).select(
        text.base_case(F.lit("application_3__ab__c")), text.span_index(F.lit("ev_1__s12")),
        text.span_index(F.lit("ev__s1x")), text.clip(F.lit("abcdef"), 3),
        text.strip(F.lit("\t a b \n")),
        text.format_props(F.create_map(F.lit("text"), F.lit("t"), F.lit("name"), F.lit("n"),
                                       F.lit("id"), F.lit("z"), F.lit("frequency"), F.lit("3"))),
        text.evidence_details(F.create_map(F.lit("name"), F.lit("  ")), F.lit(False), F.lit(0)),
    ).first()
    assert tuple(row) == (
        "application_3", 12, 0, "abc…", "a b", 'n | frequency=3 | "t"', '"(no text)", other'
    )
