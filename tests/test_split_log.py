import json
import random

import pytest

from caseweave.operators import timeline
from caseweave.sources import event_log, split_log

TEXTS = ['plain', 'a } in "quotes" {[', 'back\\slash\\', 'line\nbreak\t', 'é}]', '', '"events": [{', ',{}']


def _log(rng, n):
    def event(i):
        made = {
            "type": rng.choice(["O_Sent", "A } start", 'x"y']), "time": f"2016-01-{rng.randint(1, 28):02d}",
            "attributes": [
                {"name": rng.choice(TEXTS), "value": rng.choice(TEXTS)} for _ in range(rng.randint(0, 3))
            ],
            "relationships": [{"objectId": rng.choice(["o1", "", "o}2"])} for _ in range(rng.randint(0, 2))],
            "other": {"nested": [{"events": [{"type": "no"}]}], "n": i},
        }
        return {k: made[k] for k in rng.sample(list(made), rng.randint(1, len(made)))}

    parts = {
        "objects": [{"id": "o}1", "events": [{"type": "no"}]}], "meta": {"a": {"b": [1, 2]}}, "empty": {},
        "version": "1 \"}{", "none": [], "numbers": [1, "x]", None], "events": [event(i) for i in range(n)],
        "last": None,
    }
    kept = [k for k in parts if k == "events" or rng.random() < 0.7]
    rng.shuffle(kept)
    return {k: parts[k] for k in kept}


def _rows(events):
    return sorted(
        (r.graph_key, r.pos, r.type, r.time, str(r.attributes), str(r.object_ids)) for r in events.collect()
    )


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "700")
    yield
    for n, value in before.items():
        spark.conf.set(n, value)


def test_logs_cut_anywhere_read_like_whole_ones(spark, tmp_path, small_splits):
    rng = random.Random(5)
    for i in range(24):
        folder = tmp_path / f"case {i}"
        folder.mkdir()
        layout = rng.choice([{}, {"indent": 1}, {"separators": (",", ":")}, {"ensure_ascii": False}])
        text = json.dumps(_log(rng, rng.choice([0, 1, 2, 30])), **layout) + rng.choice(["", "\n", " \n\t"])
        (folder / event_log.LOG_FILE).write_text(text, "utf-8")
    whole = _rows(event_log.flatten(event_log.read_logs(spark, str(tmp_path))))
    assert len(whole) > 100
    assert _rows(split_log.read_events(spark, str(tmp_path))) == whole
    names = {r.graph_key for r in split_log.log_names(spark, str(tmp_path)).collect()}
    assert names == {f"case {i}" for i in range(24)}


def test_one_large_log_is_read_by_several_tasks(spark, tmp_path):
    folder = tmp_path / "app_1"
    folder.mkdir()
    events = [
        {"type": f"A_{i % 7}", "time": f"2016-{i * 7 % 12 + 1:02d}", "relationships": [{"objectId": f"o{i}"}]}
        for i in range(60_000)
    ]
    (folder / event_log.LOG_FILE).write_text(json.dumps({"events": events}))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600000")
    try:
        pieces = split_log._pieces(spark, f"{tmp_path}/*/{event_log.LOG_FILE}")
        assert pieces.select("split").distinct().count() > 5
        got = split_log.read_events(spark, str(tmp_path))
        lines = timeline.timeline_lines(got, use_email=True)
        text = timeline.timeline_texts(split_log.log_names(spark, str(tmp_path)), lines).first().body
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    order = sorted(range(len(events)), key=lambda i: (events[i]["time"], i))
    assert text.split("\n") == [
        f"- {events[i]['time']} | {events[i]['type']} [objects: o{i}]" for i in order
    ]


@pytest.mark.parametrize("text", [
    '{"events": [{"type": "a"}]', '{"events": [{"type": "a"}', '{"events": [{"type": "a}]}',
    '{"events": [{"type": "a"}]} more', '{"events": [{"type": nonsense"}]}"',
])
def test_broken_logs_fail(spark, tmp_path, text):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / event_log.LOG_FILE).write_text(text)
    with pytest.raises(Exception, match="broken event log|MALFORMED"):
        split_log.read_events(spark, str(tmp_path)).collect()
