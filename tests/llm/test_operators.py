"""Operators of the llm subpackage against plain versions, on small tables with odd rows."""

import collections
import hashlib
import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseweave.llm import (
    collisions, components, line_quality, mixing, ngram_join, packing, sharding, subword,
    suffixes, token_files, tokens, warc,
)

BASE = " ".join(f"w{i * 7919 % 1000}" for i in range(400))
KIND = "doc_id long, text string, lang string, source string, n_chars long, _row long, key string"


def table(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], 0, 5, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, short, long, repeated and nearly equal texts; a null id; clashing columns."""
    near = BASE.replace("w0 ", "x0 ", 1)
    texts = [None, "", " \t\n", "one two", BASE, BASE, near, BASE * 30, "a\nb\na\n" * 40, "a" * 700]
    docs = table(spark, texts, ["s", "t", None, "s", "s", "t", "s", "t", "s", "u"])
    return docs.union(spark.createDataFrame([(None, BASE, "en", "s", 0, 5, "k")], KIND)).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_words_are_encoded_like_texts():
    from tokenizers import Tokenizer

    vocabulary = tokens.default_vocabulary()
    plain = Tokenizer.from_file(vocabulary)
    rng = np.random.default_rng(1)
    alphabet = [*"aB'ſΣςİé́ \n\t\x0b\x1c\x85\xa0<|>7㏎", "<|endoftext|>", "don't"]
    texts = ["".join(rng.choice(alphabet, 40)) for _ in range(500)] + ["", "Cafés, été."]
    encoder = tokens.Encoder(vocabulary, cache_words=100)
    for a in range(0, len(texts), 50):
        part = texts[a : a + 50]
        ids, n = encoder.encode([t.encode() for t in part])
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [
            plain.encode(t, add_special_tokens=False).ids for t in part
        ]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(40, 30), (30, 40), (50, 50)], "a long, b long")
    got = dict(map(tuple, components.components(links).collect()))
    assert got == {**{i: 1 for i in range(1, 21)}, 30: 30, 40: 30}


def test_components_of_stars_take_no_round(spark, monkeypatch):
    write, written = components.materialise, []
    monkeypatch.setattr(components, "materialise", lambda df, name: written.append(name) or write(df, name))
    links = spark.createDataFrame([(1, 5), (1, 9), (7, 2), (1, 9)], "a long, b long")
    got = dict(map(tuple, components.components(links).collect()))
    assert got == {1: 1, 5: 1, 9: 1, 2: 2, 7: 2} and written == ["links"]
    path = spark.createDataFrame([(i, i + 1) for i in range(4)], "a long, b long")
    assert dict(map(tuple, components.components(path).collect())) == dict.fromkeys(range(5), 0)


def test_line_quality_on_odd_rows(odd, none):
    got = by_id(line_quality.judge(odd, carry=["doc_id"]))
    assert got[0]["n_words"] == 0 and got[0]["base_failed"] and not got[1]["kept"]
    assert got[8]["n_dup_lines"] == 118 and got[8]["n_repeat_words"] == 120
    assert got[4]["kept"] and got[4]["n_repeat_words"] == 0
    assert line_quality.judge(none).count() == 0


def test_common_line_goes_and_depleted_document_is_rejected(spark):
    common = "same line " + " ".join(f"c{i}" for i in range(80))
    texts = [f"{common}\n" + " ".join(f"t{i}x{j}" for j in range(200)) for i in range(20)]
    texts.append(common + "\nfew own words")
    judged = line_quality.judge(table(spark, texts))
    rows = by_id(judged.withColumn("left", line_quality.without_common_lines(F.col("text"), F.col("common"))))
    assert rows[3]["kept"] and "same line" not in rows[3]["left"] and "t3x7" in rows[3]["left"]
    assert not rows[20]["kept"] and not rows[20]["base_failed"]


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return [(len(s), g) for s, g in zip(sets, group)]


def test_jaccard_join_equals_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"v{i}" for i in range(60)]
    texts = [None, "", "one", "ONE", "one two three four", " ".join(base), " ".join(base)]
    for _ in range(60):  # near copies around the limit, many in one column
        w = list(base[: rng.integers(48, 61)])
        for at in rng.integers(0, len(w), rng.integers(0, 3)):
            w[at] = f"z{rng.integers(50)}"
        texts.append(" ".join(w))
    want = brute_components(texts)
    for name, value in (("CROWD", 12), ("CROWD", 3), ("SPLIT", 4)):
        monkeypatch.setattr(ngram_join, name, value)
        monkeypatch.setattr(ngram_join, "HEAVY", min(8, ngram_join.CROWD))
        got = by_id(ngram_join.near_copies(table(spark, texts)))
        assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == want


@pytest.mark.parametrize("most", [0, 5])
def test_jaccard_join_needs_no_list_of_heavy_columns(spark, monkeypatch, most):
    texts = []
    for p in range(8):  # a column that 30 pairs of near copies have in common
        phrase = [f"p{p}x{i}" for i in range(5)]
        for k in range(30):
            own = [f"q{p}x{k}x{i}" for i in range(8)]
            texts += [" ".join(phrase + own + [end]) for end in ("a", "b")]
    monkeypatch.setattr(ngram_join, "MOST_HEAVY", most)
    got = by_id(ngram_join.near_copies(table(spark, texts)))
    want = brute_components(texts)
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == want


def test_rows_of_a_crowd_meet_by_size_and_rest(spark):
    rng = np.random.default_rng(9)
    sizes = rng.integers(1, 120, 150)
    rows = [(1, i, int(n), int(n - rng.integers(0, n // 5 + 1)), str(i)) for i, n in enumerate(sizes)]
    # 300 rows that have 85 of 100 columns in common, which is too little for a link
    rows += [(2, 1000 + i, 100, 85, str(1000 + i)) for i in range(300)]
    smaller, larger = ngram_join.crowd_sides(
        spark.createDataFrame(rows, "column long, who long, n long, rest long, label string")
    )
    met = smaller.join(larger, ["column", "bucket", "bucket_b"]).select("column", "who", "b").collect()
    assert not [r for r in met if r["column"] == 2]
    met = [(r["who"], r["b"]) for r in met]
    assert len(met) == len(set(met))
    want = {
        (a, b) for _, a, n, x, _ in rows[:150] for _, b, m, y, _ in rows[:150]
        if (n, a) < (m, b) and 5 * n >= 4 * m and 9 * min(x, y) >= 4 * (n + m)
    }
    assert want and want <= set(met)


def test_sets_are_picked_without_a_list_in_the_driver(spark, monkeypatch):
    texts = table(spark, ["a b c", "d e f", "a b c", None, "g h"]).select(F.col("text").alias("t"))
    name = ngram_join.class_of(ngram_join.Grams().sets([b"a b c"])[0])
    who = int(np.frombuffer(name, "<i8", 1)[0])
    wanted = spark.createDataFrame([(who,)], "who long")

    def collected(*_):
        raise AssertionError("class numbers were collected")

    for action in ("toArrow", "collect", "toPandas"):
        monkeypatch.setattr(type(wanted), action, collected)
    sets = ngram_join.gathered(texts, wanted)
    monkeypatch.undo()
    assert [(r["who"], bytes(r["class"])) for r in sets.collect()] == [(who, name)]


def test_jaccard_join_on_odd_rows(odd, none):
    got = by_id(ngram_join.near_copies(odd))
    assert got[0]["n_shingles"] == 0 and got[0]["component_id"] == 0
    assert got[5]["component_id"] == 4 and got[6]["component_id"] == 4 and got[None]["component_id"] == 4
    assert ngram_join.near_copies(none).count() == 0


def brute_spans(texts):
    count = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        bad = np.cumsum(gone[:-1]) > 0
        runs = int((np.diff(np.append(0, bad.astype(int))) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~bad])
        out.append((len(t), int(bad.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("wide", [200_000, 3])
def test_repeated_strings_equal_brute_force(spark, monkeypatch, wide):
    monkeypatch.setattr(suffixes, "WIDE", wide)
    rng = np.random.default_rng(5)
    base = "".join(rng.choice(list("abcé \n"), 1500))
    texts = [base[:900], base[200:700] + "XYZ" + base[800:1050], "a" * 500, "ab" * 300, base[:900],
             None, "", base[700:899], base[700:900], "q" * 199, base[5:905]]
    texts += ["".join(rng.choice(list("xy"), 40)) + base[100 : 290 + i] for i in range(0, 40, 7)]
    got = by_id(suffixes.judged(table(spark, texts), ["doc_id"]))
    want = brute_spans([(t or "").encode() for t in texts])
    assert [tuple(got[i])[1:] for i in range(len(texts))] == want


def test_multikey_order_is_lexicographic():
    rows = np.random.default_rng(2).integers(0, 2, (300, 21)).astype(np.uint8)
    order, common = suffixes.multikey_order(rows)
    ranked = [rows[i].tobytes() for i in order]
    assert ranked == sorted(ranked)
    for i in range(1, len(ranked)):
        same = next((k for k in range(21) if ranked[i][k] != ranked[i - 1][k]), 21)
        assert common[i] == same


def test_mix_stays_at_targets_and_below_ceiling(spark, odd, none):
    sizes = {"a": 4000, "b": 300, None: 900}
    texts, sources = [], []
    for s, n in sizes.items():
        for i in range(10):
            texts.append(" ".join(f"{s}{i}" for _ in range(n // 10)))
            sources.append(s)
    rows = mixing.taken_words(table(spark, texts, sources)).collect()
    by = collections.defaultdict(lambda: [0, 0])
    for r in rows:
        assert r["taken"] <= 3 * r["size"]
        by[r["source_size"]][0] += r["taken"]
        by[r["source_size"]][1] = r["target"]
    # weights 1, 2, 3 of 5,200 words: b and null are at three times their size
    assert {k: v[1] for k, v in by.items()} == {4000: 1600.0, 300: 900.0, 900: 2700.0}
    assert all(abs(taken - target) <= 64 for taken, target in by.values())
    again = mixing.taken_words(table(spark, texts, sources)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    assert mixing.taken_words(odd).count() == 11 and mixing.taken_words(none).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_shards_are_even_and_keep_texts_together(spark, odd, none):
    rng = np.random.default_rng(4)
    texts = ["x" * int(n) for n in rng.integers(1, 400, 900)] + ["big" * 40] * 300
    for chunk in (20_000, 100):
        rows = sharding.shard(table(spark, texts), chunk=chunk).collect()
        sums, slots, at = collections.Counter(), collections.defaultdict(set), collections.defaultdict(set)
        for r in rows:
            sums[r["shard"]] += r["size"]
            slots[r["shard"]].add(r["slot"])
            at[r["text_crc32"]].add(r["shard"])
        assert len(sums) == 24 and max(sums.values()) - min(sums.values()) < 0.02 * max(sums.values())
        assert all(s == set(range(len(s))) for s in slots.values())
        wide = zlib.crc32(("big" * 40).encode())  # more than a shard's share: split
        assert all(len(s) == 1 for crc, s in at.items() if crc != wide)
    assert sharding.shard(odd).count() == 11 and sharding.shard(none).count() == 0


def test_token_files_round_trip(spark, odd, none):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.default_vocabulary())
    folder = token_files.files_dir(spark, "ids")
    files = token_files.write(odd, folder, tokens.default_vocabulary())
    rows = token_files.read(files, folder).orderBy("start").collect()
    texts = [r["text"] or "" for r in sorted(odd.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))]
    start = 0
    for r, t in zip(rows, texts, strict=True):
        ids = plain.encode(t, add_special_tokens=False).ids + [1]
        raw = np.array(ids, "<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids"], r["ids_crc32"]) == (start, len(ids), raw, zlib.crc32(raw))
        start += len(ids)
    assert token_files.read(token_files.write(none, folder, tokens.default_vocabulary()), folder).count() == 0


def test_reader_fetches_one_frame_and_sees_damage():
    sink = io.BytesIO()
    writer = token_files.Writer(sink, frame_bytes=400)
    for i in range(50):
        writer.add(None if i == 7 else i, np.arange(i, 2 * i, dtype=np.uint32))
    writer.close()
    reader = token_files.Reader(sink)
    assert reader.document(reader.find(30)[0]).tolist() == list(range(30, 60))
    assert reader.find(None) == [7] and len(reader.packed) > 5
    data = bytearray(sink.getvalue())
    data[int(reader.at[2]) + 12] ^= 255
    broken = token_files.Reader(io.BytesIO(bytes(data)))
    bad = 0
    for i in range(50):
        try:
            broken.document(i)
        except token_files.Damaged:
            bad += 1
    assert 0 < bad < 25


def test_packing_is_gapless_and_tight(spark, odd, none):
    rng = np.random.default_rng(6)
    texts = [" ".join(["word"] * int(n)) for n in rng.integers(1, 1500, 300)] + ["word " * 5000]
    rows = packing.packed_documents(table(spark, texts), tokens.default_vocabulary()).collect()
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for parts in bins.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 2048
        total += at
    assert len(bins) <= -(-total // 2048) + 1
    cut = packing.pieces(odd, tokens.default_vocabulary())
    whole = packing.sequences(packing.pack(cut)).collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in whole)
    assert packing.packed_documents(none, tokens.default_vocabulary()).count() == 0


def test_fullest_combination():
    left = {1000: 2, 700: 3, 348: 1, 5: 4}
    chosen = packing.fullest(1000, sorted(left, reverse=True), left, 1048)
    assert sum(n * k for n, k in chosen.items()) == 2048 and chosen == {1000: 1, 700: 1, 348: 1}


def test_warc_round_trip_and_revisits(spark):
    pages = spark.createDataFrame(
        [(1, "a b", "x"), (2, None, "x"), (3, "c", None), (4, "d", "y"), (4, "d", "y"), (None, "e", ""),
         (None, "f", "x")], "page_id long, url string, html string",
    )
    folder = warc.files_dir(spark, "warc")
    rows = warc.read(warc.write(warc.resolved(pages), folder), folder).collect()
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows)
    assert got == sorted([
        ("1", "response", None, 1), ("2", "revisit", 1, 1), ("3", "response", None, 0),
        ("4", "response", None, 1), ("4", "revisit", 4, 1), ("None", "revisit", 3, 0),
        ("None", "revisit", 1, 1),
    ])
    assert {r["payload_digest"] for r in rows if r["page_id"] == 2} == {warc.digest(b"x")}
    empty = warc.write(warc.resolved(pages.limit(0)), folder)
    assert warc.read(empty, folder).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_recovers_and_logs_gaps(packed):
    html = [f"<p>{i}</p>".encode() * 40 for i in range(40)]
    whole = [warc.record("response", str(i), "http://x/", h, warc.digest(h), len(h)) for i, h in enumerate(html)]
    data = [warc.member(r) if packed else r for r in whole]
    broken = bytearray(data[5])
    broken[len(broken) // 2] ^= 255
    blob = b"junk" + b"".join(data[:5]) + bytes(broken) + b"".join(data[6:20]) + data[20][:30] + b"".join(data[21:])
    out = list(warc.salvage(io.BytesIO(blob)))
    assert [int(x["page"]) for x in out if "page" in x] == [i for i in range(40) if i not in (5, 20)]
    gaps = [(x["gap_start"], x["gap_end"]) for x in out if "reason" in x]
    assert sum(b - a for a, b in gaps) == 4 + len(data[5]) + 30


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((400, 16))
    x[100:160] = x[3] + 0.08 * rng.standard_normal((60, 16))
    x[200:210] = x[7]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x.astype(np.float32))]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] + [1.0] * 15, 1)]
    got = collisions.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = {r["vec_id"]: r for r in got.collect()}
    u = np.array([r[1] for r in rows[:400]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    assert [got[i]["n_links"] for i in range(400)] == (near.sum(1) - 1).tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (400, 401, 402))
    assert got[150]["component_id"] == 3 and not got[150]["kept"] and got[3]["kept"]


def test_crowds_of_embeddings_are_counted_without_their_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 32))
    # from nearly equal to half apart, so that groups lie inside, across and outside the threshold
    x[:500] = x[0] + rng.uniform(0, 0.4, (500, 1)) * rng.standard_normal((500, 32)) * 0.45
    x[500:600] = x[500] * rng.uniform(0.5, 2, (100, 1))
    table = spark.createDataFrame(
        [(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>"
    )
    got = {r["vec_id"]: r for r in collisions.near_duplicates(table).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(1) - 1
    found = np.array([got[i]["n_links"] for i in range(900)])
    assert (found <= links).all() and found.sum() >= 0.999 * links.sum()
    assert (found[500:600] == 99).all() and got[599]["component_id"] == 500

    gathered, widths = collisions.gathered_classes(collisions.classes(table)[1], 0.95)
    assert widths == [(32, 900)] and gathered.where("crowded").count() > 2 * collisions.CROWD
    pairs = collisions.candidates(gathered, 900, 32)
    near = collisions.compared(gathered, pairs, 32, 0.95)
    # written as pairs are groups, fewer than the links of their members
    assert near.count() < links.sum() / 4
    assert near.where("NOT whole").count() > 0


def test_embeddings_of_every_width_are_compared(spark):
    rng = np.random.default_rng(4)
    wide, small = rng.standard_normal((30, 16)), rng.standard_normal((6, 8))
    small[1], small[2] = small[0], small[0] + 0.001
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate([*wide, *small])]
    rows += [(36, [1.0, 2.0], 0), (37, None, 0)]
    got = collisions.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    got = {r["vec_id"]: r for r in got.collect()}
    for group in (wide, small):
        u = group / np.linalg.norm(group, axis=1, keepdims=True)
        at = 0 if group is wide else 30
        links = ((u @ u.T >= 0.95).sum(1) - 1).tolist()
        assert [got[at + i]["n_links"] for i in range(len(u))] == links
    assert got[31]["component_id"] == got[32]["component_id"] == 30 and got[31]["n_links"] == 2
    assert got[36]["n_links"] == got[37]["n_links"] == 0 and got[36]["kept"]


def test_classifier_on_held_out_rows(spark, odd, none):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["good", "prose", "reads", "well"], 60)) if i % 2 else
             " ".join(rng.choice(["xx##", "$$buy", "now%%", "!!!"], 60)) for i in range(240)]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(240)], "doc_id long, quality int, toxic int")
    got = by_id(subword.score(docs, labels))
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held == [i for i in sorted(got) if got[i]["held_out"]]
    assert all(got[i]["predicted"] == i % 2 for i in held)
    assert all(0 <= r["score"] <= 1 for r in subword.score(odd, labels).collect())
    assert subword.score(none, labels).count() == 0
    assert subword.score(odd, labels.limit(0)).count() == 11


def test_classifier_on_few_rows_of_uneven_classes(spark):
    """300 labelled rows, 88 % of one class; ids that come several times."""
    rng = np.random.default_rng(12)
    words = [f"word{i}" for i in range(400)]
    signs = ["%%", "***", "$$", "&&"]
    labelled = [int(i % 25 >= 3) for i in range(300)]
    texts = [
        " ".join(w + ("" if y else str(rng.choice(signs))) for w in rng.choice(words, 80)) for y in labelled
    ]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, y, 0) for i, y in enumerate(labelled)], "doc_id long, quality int, toxic int")
    got = by_id(subword.score(docs, labels))
    held = [i for i in got if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == labelled[i] for i in held) >= 0.97 * len(held)
    again = docs.union(docs).union(docs.where("doc_id < 50").withColumn("text", F.lit("other words")))
    rows = subword.sample(again, labels.union(labels.limit(20)), limit=100)
    assert len(rows) <= 100 and sum(len(b) for _, b, _ in rows) > 0


def test_scores_are_the_average_of_the_features_of_whole_texts():
    rng = np.random.default_rng(5)
    part, bias = rng.standard_normal(subword.BUCKETS), 0.25
    texts = [b"", b" \n", b"one", b"one one two", "é ü 日本 é".encode(), b"a b " * 5000]
    scorer = subword.Scorer(part, bias)
    for _ in range(2):
        for text, score in zip(texts, scorer.score(texts)):
            found = subword.document_features(text.split())
            z = bias + (part[found].mean() if len(found) else 0)
            assert score == pytest.approx(1 / (1 + np.exp(-z)))
