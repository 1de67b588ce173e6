"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is the sequence of its leaf blocks (``page_blocks``). A block's features
are the tags of all its ancestors, the words of their classes, ids and roles
(those of the nearest named one once more), its own tag, and the look of its text: number of words, share of characters
inside links, punctuation, digits, capitals. The field has one weight per
feature for "main" and a weight per pair of neighbouring labels; it is trained
in numpy by the gradient of the conditional likelihood (forward and backward
sums over all training pages at once) on ``PAGES`` labelled pages
(``page_samples``), and decoded by Viterbi. The model is a dictionary of some
hundred weights, which every task gets. Pages are independent rows, so
nothing is shuffled.

The text of a page is its main blocks in page order, joined by one line feed.
White space inside a block is one space; nothing else is dropped or cut.

Defined cases: a null or empty page, or one without text, gives an empty text
and ``n_chars`` 0; null ids and urls are kept; rows may repeat, each gives its
row. A very long page is one row of a task, read in a time that grows with its
length. Truncated pages count as far as they go; a tag that the end cuts off is
dropped. Only the named columns are read, whatever others are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm.common import load
from caseweave.llm.page_blocks import Element, blocks, root
from caseweave.llm.page_samples import MARK, labelled_pages

#: Labelled pages, steps of the descent, its rate, and the pull of weights to zero.
PAGES, STEPS, RATE, PULL = 1500, 120, 0.3, 0.001
SEED = 11
WORD_STEPS = (1, 3, 7, 15, 40)
ENDINGS = frozenset(".!?:;…。！？\"'»”)")


def text_features(leaf: str, text: str, linked: int) -> tuple[str, ...]:
    """The look of a block's text, some of it together with the block's tag."""
    words = text.count(" ") + 1
    size = sum(words > step for step in WORD_STEPS)
    share = 4 * min(linked, len(text)) // len(text)
    last = text[-1] in ENDINGS
    out = [f"w:{size}", f"d:{share}", f"l:{leaf}", f"ld:{leaf}:{share}", f"ls:{leaf}:{size}", f"e:{last}:{size}"]
    if "," in text:
        out.append("comma")
    if "©" in text:
        out.append("copy")
    if "|" in text or "·" in text:
        out.append("bar")
    if words < 8 and sum(map(str.isdigit, text)) * 3 > len(text):
        out.append("digits")
    return tuple(out)


class Field:
    """Weights of the features for main text, and of label pairs (other, main) in a row."""

    def __init__(self, weights: dict[str, float], start: np.ndarray, pairs: np.ndarray):
        self.weights = weights
        self.start, self.pairs = start.tolist(), pairs.tolist()
        self.known: dict[tuple[str, ...], float] = {}

    def emission(self, element: Element, text: str, linked: int) -> float:
        get = self.weights.get
        if element.score is None:
            element.score = sum(get(f, 0.0) for f in chain(element.path, element.near))
        look = text_features(element.name, text, linked)
        score = self.known.get(look)
        if score is None:
            score = self.known[look] = sum(get(f, 0.0) for f in look)
        return element.score + score

    def decode(self, emissions: list[float]) -> list[bool]:
        """The labels of the likeliest sequence; ties go to main."""
        if not emissions:
            return []
        (oo, om), (mo, mm) = self.pairs
        other, main = self.start[0], self.start[1] + emissions[0]
        came = []
        for e in emissions[1:]:
            to_other = (main + mo, True) if main + mo >= other + oo else (other + oo, False)
            to_main = (main + mm, True) if main + mm >= other + om else (other + om, False)
            came.append((to_other[1], to_main[1]))
            other, main = to_other[0], to_main[0] + e
        labels = [main >= other]
        for from_other, from_main in reversed(came):
            labels.append(from_main if labels[-1] else from_other)
        return labels[::-1]

    def main_text(self, page: str, top: Element) -> str:
        found = blocks(page, top)
        labels = self.decode([self.emission(*b) for b in found])
        return "\n".join(b[1] for b, main in zip(found, labels) if main)


def examples(pages: list[str]) -> list[tuple[list[list[str]], list[bool]]]:
    """Features and labels of the blocks of each labelled page."""
    out, top = [], root()
    for page in pages:
        found = blocks(page, top)
        labels = [MARK in text for _, text, _ in found]
        rows = [(e, text.replace(MARK, ""), linked) for e, text, linked in found]
        kept = [i for i, (_, text, _) in enumerate(rows) if text]
        if kept:
            out.append((
                [[*rows[i][0].path, *rows[i][0].near, *text_features(rows[i][0].name, *rows[i][1:])] for i in kept],
                [labels[i] for i in kept],
            ))
    return out


def train(pages: list[str], steps: int = STEPS, rate: float = RATE, pull: float = PULL) -> Field:
    """Maximise the conditional likelihood of the labels, by adaptive steps on all pages at once."""
    data = examples(pages)
    names: dict[str, int] = {}
    flat = [[names.setdefault(f, len(names)) for f in row] for rows, _ in data for row in rows]
    feature = np.array([f for row in flat for f in row])
    owner = np.repeat(np.arange(len(flat)), [len(row) for row in flat])
    sizes = np.array([len(labels) for _, labels in data])
    count, longest = len(data), int(sizes.max())
    page = np.repeat(np.arange(count), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    label = np.array([y for _, labels in data for y in labels], int)
    there = np.arange(longest)[:, None] < sizes
    truth = np.zeros((longest, count), int)
    truth[place, page] = label
    inner = there[1:]
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (truth[:-1][inner], truth[1:][inner]), 1)
    seen_start = np.bincount(truth[0], minlength=2)

    # weights, then start, then pairs; sums run over places, for all pages at once
    w = np.zeros(len(names) + 6)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        start, ((oo, om), (mo, mm)) = w[-6:-4], w[-4:].reshape(2, 2)
        emission = np.zeros((longest, count))
        emission[place, page] = np.bincount(owner, w[feature], len(flat))
        ahead = np.empty((2, longest, count))
        back = np.zeros((2, longest, count))
        ahead[0, 0], ahead[1, 0] = start[0], start[1] + emission[0]
        for t in range(1, longest):
            o, m = ahead[:, t - 1]
            ahead[0, t] = np.where(there[t], np.logaddexp(o + oo, m + mo), o)
            ahead[1, t] = np.where(there[t], np.logaddexp(o + om, m + mm) + emission[t], m)
        for t in range(longest - 1, 0, -1):
            o, m = back[0, t], back[1, t] + emission[t]
            back[0, t - 1] = np.where(there[t], np.logaddexp(o + oo, m + om), 0.0)
            back[1, t - 1] = np.where(there[t], np.logaddexp(o + mo, m + mm), 0.0)
        total = np.logaddexp(ahead[0, -1], ahead[1, -1])
        after = np.stack([back[0], back[1] + emission])[:, 1:]
        both = [
            [np.exp(ahead[a, :-1] + w[-4 + 2 * a + b] + after[b] - total)[inner].sum() for b in (0, 1)]
            for a in (0, 1)
        ]
        main = np.exp(ahead[1] + back[1] - total)
        miss = label - main[place, page]
        grad = np.concatenate([
            np.bincount(feature, miss[owner], len(names)),
            seen_start - np.array([count - main[0].sum(), main[0].sum()]),
            (seen_pairs - np.array(both)).ravel(),
        ]) - pull * count / 100 * w
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        w = w + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field({f: float(w[i]) for f, i in names.items()}, w[-6:-4], w[-4:].reshape(2, 2))


def trained(pages: int = PAGES, seed: int = SEED) -> Field:
    return train(labelled_pages(pages, seed))


def extract(
    pages: DataFrame, field: Field | None = None, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """page_id, url, main text and its number of characters for each page."""
    # some hundred weights, which go along with the function
    model = field or trained()

    def run(tables: Iterator):
        import pyarrow as pa

        for part in tables:
            top = root()
            texts = [model.main_text(h or "", top) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                    pa.array(list(map(len, texts)), pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.col(html).cast("string").alias("html"),
    )
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op11_dom_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages"))
