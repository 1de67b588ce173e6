"""Registered operators and the pipeline on small tables, against plain Python."""

import base64
import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from caseweave.llm import collisions, mixing, packing, queries, suffixes, tokens, warc

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(21)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(90):
        text = " ".join(rng.choice(words, rng.integers(60, 400)))
        rows.append((i, text, f"s{i % 4}" if i % 9 else None))
    rows += [(90, None, "s0"), (91, "", "s1"), (92, " \t\n", "s2"), (93, rows[5][1], "s0"), (94, rows[5][1], "s3")]
    rows += [(95, "é ü 日本 " * 900, "s1"), (96, " ".join(rng.choice(words, 5000)), "s2")]
    return rows


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    documents(spark, corpus).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def encoded(rows, end):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.default_vocabulary())
    return {i: plain.encode(t or "", add_special_tokens=False).ids + [end] for i, t, _ in rows}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_shards_hold_whole_groups_and_even_bytes(spark, corpus, folder):
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_karmarkar_karp"](spark, folder).collect()}
    assert set(got) == {i for i, _, _ in corpus}
    bytes_of = collections.Counter()
    slots = collections.defaultdict(list)
    for i, text, _ in corpus:
        body = (text or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"], got[i]["law"]) == (len(body) + 8, zlib.crc32(body), "bytes")
        bytes_of[got[i]["shard"]] += got[i]["size"]
        slots[got[i]["shard"]].append(got[i]["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    assert got[93]["shard"] == got[94]["shard"] == got[5]["shard"]
    # no worse than giving the next largest group to the lightest shard
    groups = collections.Counter()
    for i, text, _ in corpus:
        groups[text] += got[i]["size"]
    light = [0] * 24
    for size in sorted(groups.values(), reverse=True):
        light[light.index(min(light))] += size
    even = [bytes_of[s] for s in range(24)]
    assert max(even) - min(even) <= max(light) - min(light)


def plain_targets(rows):
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        share = left / sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and share * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in full else share * weight[s] for s in names}, sizes
        full |= over


def test_mix_meets_plain_targets_block_by_block(spark, corpus, folder):
    query = queries.QUERIES["op6_multinomial_mix"]
    got = {r["doc_id"]: r for r in query(spark, folder).collect()}
    assert {i: r["taken"] for i, r in got.items()} == {r["doc_id"]: r["taken"] for r in query(spark, folder).collect()}
    want, sizes = plain_targets(corpus)
    taken = collections.Counter()
    for i, text, source in corpus:
        n = len(WORD.findall(text or ""))
        assert got[i]["size"] == n and got[i]["source_size"] == sizes[source]
        assert got[i]["target"] == pytest.approx(want[source])
        assert 0 <= got[i]["taken"] <= 3 * n
        taken[source] += got[i]["taken"]
    assert all(abs(taken[s] - want[s]) <= 2 * mixing.BLOCK for s in want)
    # every pass over a source is a permutation of its blocks
    rows = mixing.sized(documents(spark, corpus), "doc_id", "text", "source")
    sources = mixing.targets(rows)
    blocks = {r["_s"]: r["_blocks"] for r in sources.collect()}
    order = collections.defaultdict(list)
    for r in mixing.permuted(sources).collect():
        order[r["_s"]].append((r["_place"], r["_block"]))
    for s, found in order.items():
        assert sorted(p for p, _ in found) == sorted(b for _, b in found) == list(range(blocks[s]))
        assert len(found) < 8 or [b for _, b in sorted(found)] != sorted(b for _, b in found)
    slots = collections.defaultdict(set)
    for r in mixing.mix(rows, sources).collect():
        slots[r["_s"], r["_epoch"]].add(r["_slot"] % blocks[r["_s"]])
    for (s, epoch), found in slots.items():
        assert len(found) == blocks[s] or (s, epoch + 1) not in slots


def test_packed_pieces_are_the_tokens_of_the_documents(spark, corpus, folder):
    ids = encoded(corpus, packing.END_ID)
    got = queries.QUERIES["op10_min_slack"](spark, folder).collect()
    assert collections.Counter(r["doc_id"] for r in got) == {i: -(-len(x) // 2048) for i, x in ids.items()}
    for r in got:
        part = ids[r["doc_id"]][r["piece"] * 2048 : (r["piece"] + 1) * 2048]
        assert (r["start"], r["length"], r["ids_crc32"]) == (r["piece"] * 2048, len(part), crc(part))
    held = collections.defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for found in held.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    # no more than the longest first, each where it fits first
    room = []
    for length in sorted((r["length"] for r in got), reverse=True):
        fits = next((b for b, left in enumerate(room) if left >= length), None)
        if fits is None:
            room.append(2048 - length)
        else:
            room[fits] -= length
    assert len(held) <= len(room)


def fewest(lengths, room):
    """The least number of bins, by trying all assignments."""
    best = len(lengths)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= room:
                put(i + 1, bins[:b] + [bins[b] + lengths[i]] + bins[b + 1 :])
        put(i + 1, [*bins, lengths[i]])

    put(0, [])
    return best


def test_few_pieces_are_packed_in_as_few_bins_as_possible():
    rng = np.random.default_rng(2)
    over = 0
    for _ in range(60):
        lengths = rng.integers(1, 40, rng.integers(1, 9)).tolist()
        plan = packing.plan(dict(collections.Counter(lengths)), 50)
        used = collections.Counter()
        for times, filling in plan:
            assert sum(n * c for n, c in filling.items()) <= 50
            for n, c in filling.items():
                used[n] += times * c
        assert used == collections.Counter(lengths)
        over += sum(times for times, _ in plan) - fewest(sorted(lengths, reverse=True), 50)
    assert over <= 2


def test_token_files_hold_ids_in_order(spark, corpus, folder):
    ids = encoded(corpus, 1)
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_seekable_ids"](spark, folder).collect()}
    at = 0
    for i in sorted(ids):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids[i]), crc(ids[i]))
        at += len(ids[i])


def test_archives_revisit_the_first_page_of_equal_payload(spark, tmp_path):
    htmls = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "<p>é</p>" * 50_000, "<p>b</p>"]
    rows = [(10 - i, f"http://x/{i}", h, "r", 3) for i, h in enumerate(htmls)]
    kind = "page_id long, url string, html string, record_type string, payload_bytes int"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/pages.parquet")
    first = {}
    for i, _, h, *_ in sorted(rows):
        first.setdefault(h or "", i)
    want = []
    for i, _, h, *_ in rows:
        data = (h or "").encode()
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        again = first[h or ""] != i
        want.append((i, len(data), sha, "revisit" if again else "response", first[h or ""] if again else None))
    got = queries.QUERIES["op9_salvage"](spark, str(tmp_path)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_vectors_without_rows_and_without_ids(spark):
    kind = "vec_id long, embedding array<double>, label int, component_id string"
    rows = [(None, [1.0, 0.0], 0, "x"), (4, [1.0, 0.0], 0, "x"), (4, [1.0, 0.001], 1, "y"), (5, [0.0, 1.0], 0, "z")]
    table = spark.createDataFrame(rows, kind)
    assert collisions.near_duplicates(table.limit(0)).count() == 0
    got = collisions.near_duplicates(table).collect()
    assert len(got) == 4
    assert sorted(r["n_links"] for r in got) == [0, 2, 2, 2]
    assert all(r["component_id"] == 4 for r in got if r["vec_id"] == 4)


def test_repeated_strings_without_rows_and_without_ids(spark):
    shared = "".join(chr(97 + i * i % 23) for i in range(260))
    rows = [(None, "left one " + shared), (1, shared + " right two"), (1, "own " * 30), (2, None)]
    kind = "doc_id long, text string, key string, copies int, n_bytes string"
    table = spark.createDataFrame([(*r, "k", 7, "n") for r in rows], kind)
    assert suffixes.judged(table.limit(0), ["doc_id"]).count() == 0
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffixes.judged(table, ["doc_id"]).collect()}
    sizes = [len(t or "") for _, t in rows]
    assert got == {(None, sizes[0]): 260, (1, sizes[1]): 260, (1, sizes[2]): 0, (2, 0): 0}


def plain_pipeline(rows):
    """Five stages in plain Python, for a single source, of which the mix takes every word once."""
    kept = []
    for i, text, _ in rows:
        words = WORD.findall(text or "")
        windows = collections.Counter(zip(words, words[1:], words[2:]))
        again = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
        if len(words) >= 50 and 100 * len(again) <= 50 * len(words):
            kept.append((i, text))
    distinct = len({t for _, t, _ in rows})
    holders = collections.defaultdict(set)
    for _, text, _ in rows:
        for line in (text or "").split("\n"):
            if line.strip():
                holders[line.strip().lower()].add(text)
    common = {k for k, v in holders.items() if len(v) >= 10 and len(v) > 0.1 * distinct}
    cleaned = []
    for i, text in kept:
        lines = [x for x in text.split("\n") if x.strip().lower() not in common]
        gone = sum(len(x.strip()) for x in text.split("\n") if x.strip().lower() in common)
        if gone <= 0.5 * sum(len(x.strip()) for x in text.split("\n")):
            cleaned.append((i, "\n".join(lines)))
    shingles = {i: set(zip(*[WORD.findall(t.lower())[k:] for k in range(5)])) for i, t in cleaned}
    group = {i: i for i, _ in cleaned}

    def top(i):
        return i if group[i] == i else top(group[i])

    for a, b in itertools.combinations(shingles, 2):
        if 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b]):
            x, y = sorted((top(a), top(b)))
            group[y] = x
    single = [(i, t) for i, t in cleaned if top(i) == i]
    starts = collections.Counter(
        t.encode()[k : k + 200] for _, t in single for k in range(len(t.encode()) - 199)
    )
    out = []
    for i, text in single:
        data = text.encode()
        gone = {k + d for k in range(len(data) - 199) if starts[data[k : k + 200]] > 1 for d in range(200)}
        out.append((i, bytes(b for k, b in enumerate(data) if k not in gone).decode()))
    return [(i, t, "s") for i, t in out if WORD.findall(t)]


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rng = np.random.default_rng(33)
    words = [f"w{i}" for i in range(2000)]
    passage = " ".join(rng.choice(words, 80))
    line = "Please read our terms of use before you go on."
    rows = []
    for i in range(40):
        body = [" ".join(rng.choice(words, rng.integers(40, 90))) for _ in range(rng.integers(2, 5))]
        if i % 5 == 0:
            body.insert(1, passage)
        if i % 3 == 0:
            body.append(line)
        rows.append((i, "\n".join(body), "s"))
    rows += [(40, rows[7][1], "s"), (41, rows[8][1] + " w1 w2", "s"), (42, "too short", "s"), (43, None, "s")]
    rows += [(44, "same words here " * 60, "s")]
    documents(spark, rows).drop("size", "shard").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = plain_pipeline(rows)
    assert 20 < len(want) < 42
    ids = encoded(want, packing.END_ID)
    pieces = {
        (i, k): (2048 * k, len(x[2048 * k : 2048 * k + 2048]), crc(x[2048 * k : 2048 * k + 2048]))
        for i, x in ids.items() for k in range(-(-len(x) // 2048))
    }
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == pieces
    assert len(got) == len(pieces)
