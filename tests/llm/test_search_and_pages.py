"""Ranked search, whitening and page text against plain versions, on small tables with odd rows."""

import collections
import html
import math
import re

import numpy as np
import pytest

from caseweave.llm import page_blocks, page_samples, page_text, term_search, whitening

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain_search(docs, items, best):
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    count, total = len(held), sum(n for *_, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in held:
            m, score = 50 + (50 * n * count) // total, 0
            for t in set(terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                score += w * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, i is None, i, score))
        out += [(item, k + 1, f[2], f[3]) for k, f in enumerate(sorted(found, key=lambda f: f[:2] + (f[2] or 0,))[:best])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def library():
    rng = np.random.default_rng(3)
    words = [f"Wort{i}" for i in range(300)] + ["the", "OF", "É", "ſ", "a1", "日本"]
    chance = 1 / np.arange(1, len(words) + 1)
    rng.shuffle(words)
    texts = [" ".join(rng.choice(words, rng.integers(1, 60), p=chance / chance.sum())) for _ in range(400)]
    texts += ["", None, " .,;!", texts[3], texts[3], "the " * 5000, "\x00Wort7\x7fwort7{É}"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[5]), (7, texts[5])]
    items = [(i, texts[i] + " unheard") for i in range(0, 400, 50)] + [(1, None), (2, "?!"), (3, "nowhere"), (4, texts[8])]
    return docs, items + [(4, texts[8])]


@pytest.mark.parametrize("pass_bytes", [term_search.PASS_BYTES, 300])
def test_search_equals_plain_scores(spark, library, monkeypatch, pass_bytes):
    monkeypatch.setattr(term_search, "BLOCK_DOCS", 64)
    monkeypatch.setattr(term_search, "BUNDLE", 3)
    docs, items = library
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, score int, block string")
    asked = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, doc_id int")
    got = term_search.search(table.repartition(5), asked, best=20, pass_bytes=pass_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(docs, items, 20)


def test_search_without_documents_or_items(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "two")], "item_id long, text string")
    assert term_search.search(docs.limit(0), items).count() == 0
    assert term_search.search(docs, items.limit(0)).count() == 0
    assert [r["score"] > 0 for r in term_search.search(docs, items).collect()] == [True]


def whitened(spark, rows, parts=3):
    kind = "vec_id long, embedding array<double>, n int, x string"
    table = spark.createDataFrame([(*r, 5, "x") for r in rows], kind).repartition(parts)
    return whitening.whiten(table).toPandas()


def check_whitening(got, rows):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept], np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    values, vectors = np.linalg.eigh((fit - sums / n).T @ (fit - sums / n) / n)
    k = min(4, int((values > 1e-9 * values.max()).sum()))
    assert sorted(zip(got.vec_id, got.component)) == sorted((i, c) for i, _ in kept for c in range(1, k + 1))
    assert (got.n == n).all() and (got.identity_error <= 1e-10).all()
    deviation = {i: sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums)) for i, v in kept}
    assert all(deviation[i] == d for i, d in zip(got.vec_id, got.deviation))
    for c in range(1, k + 1):
        mine = dict(zip(got.vec_id[got.component == c], got.whitened[got.component == c]))
        want = (x - sums / n) @ vectors[:, -c] / math.sqrt(values[-c])
        have = np.array([mine[i] for i, _ in kept])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-7
        share = got.explained[got.component == c].iloc[0]
        assert share == pytest.approx(values[-c] / values.sum(), rel=1e-9)


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 12)) * np.logspace(0, -4, 12) + 3
    x[100:200] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(300, None), (301, [float("nan")] * 12), (302, [1.0] * 11 + [None]), (303, [float("inf")] + [0.0] * 11)]
    check_whitening(whitened(spark, rows), rows)


@pytest.mark.parametrize("rank", [1, 2, 4])
def test_whitening_without_full_rank(spark, rank):
    rng = np.random.default_rng(rank)
    x = rng.integers(-50, 50, (60, rank)) @ rng.integers(-3, 4, (rank, 9)) / 256
    rows = [(i, v.tolist()) for i, v in enumerate(np.hstack([x, np.ones((60, 2))]))]
    check_whitening(whitened(spark, rows), rows)


def test_whitening_of_few_and_odd_vectors(spark):
    assert len(whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, []), (4, None)])) == 0
    mixed = whitened(spark, [(None, [1.0, 2.0]), (2, [1.5, 0.0]), (2, [1.0]), (5, [3.0])])
    assert sorted(mixed.n) == [2, 2, 2, 2] and set(mixed.component) == {1}
    assert sorted(np.abs(mixed.whitened).round(9)) == [1.0] * 4
    huge = whitened(spark, [(1, [1e12, 0.0]), (2, [-1e12, 1.0])])
    assert huge.deviation.isna().all() and (huge.whitened.abs().round(9) == 1).all()
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(empty).count() == 0


def texts(page):
    return [t for _, t, _ in page_blocks.blocks(page)]


def test_blocks_of_broken_markup():
    assert texts("") == texts("<p></p> \n") == []
    assert texts("a &lt;b&gt; &amp c &am; <b>d<br>e</b>\t\n f") == ["a <b> & c &am; d e f"]
    assert texts("<p>one<p>two<li>three<li>four</ul>five") == ["one", "two", "three", "four", "five"]
    assert texts("<script>x='<p>no</p>'</script><!-- <p>no --><style>p{}</style>yes<!--no") == ["yes"]
    assert texts('<p title="a>b">in</p></section><noscript>no</noscript>1 < 2') == ["in", "1 < 2"]
    assert texts("<table><tr><td>a<td>b<tr><td><table><td>c</table>d</table>e") == ["a", "b", "c", "d", "e"]
    assert texts("<p>whole</p><p>cut <a hre") == ["whole", "cut"]
    paths = [sorted(e.path) for e, *_ in page_blocks.blocks('<div class="sideBar x"><p>a</p></div><p>b')]
    assert paths == [["c:bar", "c:side", "c:x", "t:div", "t:p"], ["t:p"]]
    assert len(texts("<div>" * 5000 + "x" + "</p>" * 5000)) == 1


@pytest.fixture(scope="module")
def field():
    return page_text.trained()


def test_field_on_pages_it_was_not_trained_on(field):
    wrong = total = 0
    for page in page_samples.labelled_pages(300, 4242):
        found = page_blocks.blocks(page)
        plain = [(e, t.replace(page_samples.MARK, ""), n) for e, t, n in found]
        kept = [i for i, b in enumerate(plain) if b[1]]
        got = field.decode([field.emission(*plain[i]) for i in kept])
        wrong += sum(g != (page_samples.MARK in found[i][1]) for g, i in zip(got, kept))
        total += len(kept)
    assert wrong < 0.01 * total


def test_viterbi_finds_the_likeliest_labels(field):
    rng = np.random.default_rng(2)
    for _ in range(200):
        e = rng.normal(0, 2, rng.integers(1, 7)).tolist()

        def score(labels):
            s = field.start[labels[0]] + sum(x for x, y in zip(e, labels) if y)
            return s + sum(field.pairs[a][b] for a, b in zip(labels, labels[1:]))

        best = max(np.ndindex(*[2] * len(e)), key=score)
        assert score([int(y) for y in field.decode(e)]) == pytest.approx(score(best))


def test_extraction_of_odd_pages(spark, field):
    shell = '<nav><ul><li><a href="/">Home</a></ul></nav>{}<footer>&copy; 2020 somebody</footer>'
    story = "".join(f"<p>Sentence {i} of it, and &quot;more&quot;.</p>" for i in range(3))
    want = "\n".join(f'Sentence {i} of it, and "more".' for i in range(3))
    pages = [
        (1, "u", None), (2, None, ""), (3, "u", shell.format(f"<article>{story}</article>")),
        (3, "u", shell.format(f"<article>{story}</article>")), (None, "v", shell.format("")),
        (5, "u", shell.format(f'<div class="content">{story * 4000}</div><div id="comments"><p>I liked it, really.</p></div>')),
        (6, "u", f"<main>{story}<aside><p>Read this too, it is new.</p></aside></main><form><p>Sign up, please.</p></form>"),
    ]
    table = spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id long, url string, html string, text int, part string")
    got = page_text.extract(table, field).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert sorted((r["page_id"] or 0, r["text"]) for r in got) == sorted([
        (0, ""), (1, ""), (2, ""), (3, want), (3, want), (5, "\n".join([want] * 4000)), (6, want),
    ])
    assert page_text.extract(table.limit(0), field).count() == 0


def test_extraction_of_the_test_tables(spark, field):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in page_text.extract(pages, field).collect()}
    for r in pages.collect():
        article = re.search("<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        parts = re.split("</?(?:p|h1)>", re.sub("</?b>", "", article.replace("<br>", " ")))
        assert got[r["page_id"]] == "\n".join(filter(None, (" ".join(html.unescape(p).split()) for p in parts)))
