"""Quality classifier: learned vectors of hashed words, word pairs and character n-grams.

A document is the average of the vectors of its words, of its pairs of
neighbouring words and of its words' character n-grams (3 to 5 bytes, with marks
at both word ends), each hashed to one of ``BUCKETS`` rows. A softmax layer gives
the two class probabilities. Both are trained by stochastic gradient descent in
numpy on a bounded sample of labelled documents: the ``SAMPLE`` labels first by a
hash of the id, with one document each (that of the least hash of its text where
an id repeats). Of a sampled document the driver gets all buckets with their
shares, 8 bytes for each, and no text. The descent makes ``STEPS`` steps whatever
the size of the sample, and the bias begins at the classes' shares in it.

The softmax of an average is a function of one sum per document, so scoring
needs one number per word (its features' part of the logit), one per pair of
words, and the number of features; a worker keeps those of words it has seen.
Every whole text is scored. Labels, language, source and ids are no inputs of a
score.

Defined cases: a null, empty or blank text has no features and gets the score
of the bias alone; a null label is no label; an id with several label rows
counts once per row in training; ids may repeat or be null (a null id is held
out from learning); without any label in a class all scores are the smoothed
share of the class. Other columns are not read. A very long text is one row of
a task, its words are gone through once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm.common import load
from caseweave.llm.tokens import as_bytes, batches

BUCKETS = 1 << 17
WIDTH = 16
GRAMS = (3, 4, 5)
#: Bound of the training sample, in documents.
SAMPLE = 2_500
STEPS = 30_000
RATE = 1.0
SEED = 7
CACHE_WORDS = 400_000

STEP = np.uint64(0x100000001B3)
START = np.uint64(0xCBF29CE484222325)
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * SPREAD
    return ((h >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64)


def _marked(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words between marks, one after the other, and the size of each."""
    marked = np.frombuffer(b"".join(b"<%s>" % w for w in words), np.uint8).astype(np.uint64)
    return marked, np.fromiter(map(len, words), np.int64, len(words)) + 2


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The sum of each word's bytes, each multiplied by a power for its place."""
    marked, sizes = _marked(words)
    if not len(sizes):
        return np.empty(0, np.uint64)
    starts = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        power = STEP ** (np.arange(len(marked)) - np.repeat(starts, sizes)).astype(np.uint64)
        return np.add.reduceat(marked * power, starts)


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of each word with the next one."""
    with np.errstate(over="ignore"):
        return _bucket(hashes[:-1] * SPREAD + hashes[1:])


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of *words* and their n-grams, word after word, and the number of each word's."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    marked, sizes = _marked(words)
    owner = np.repeat(np.arange(len(words)), sizes)
    end = np.cumsum(sizes)[owner]
    found, owners = [], []
    h = np.full(len(marked), START)
    place = np.arange(len(marked))
    with np.errstate(over="ignore"):
        found.append(_bucket(word_hashes(words) + np.uint64(len(GRAMS) + 7)))
        owners.append(np.arange(len(words)))
        for n in range(1, max(GRAMS) + 1):
            h = h[: len(marked) - n + 1]
            h = (h ^ marked[n - 1 :]) * STEP
            if n in GRAMS:
                inside = place[: len(h)] + n <= end[: len(h)]
                found.append(_bucket(h[inside]))
                owners.append(owner[: len(h)][inside])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(found)[order], np.bincount(owners, minlength=len(words))


def document_features(words: list[bytes]) -> np.ndarray:
    """Buckets of all features of a document."""
    return np.concatenate([features(words)[0], pair_buckets(word_hashes(words))])


def split_of(doc_id: Column) -> Column:
    """True for documents that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> list:
    """(label, buckets, shares) of the sampled documents, as views of what the driver got."""

    def run(tables: Iterator):
        import pyarrow as pa

        for table in tables:
            buckets, shares = [], []
            for text in as_bytes(table.column("t")):
                b, c = np.unique(document_features(text.split()), return_counts=True)
                buckets.append(b.astype("<u4").tobytes())
                shares.append((c / max(1, c.sum())).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [table.column("y"), pa.array(buckets, pa.binary()), pa.array(shares, pa.binary())],
                schema=pa.schema([("y", pa.int32()), ("b", pa.binary()), ("s", pa.binary())]),
            )

    known = labels.where(F.col("quality").isNotNull()).select(
        F.col("doc_id").alias("_id"), (F.col("quality") > 0).cast("int").alias("y")
    )
    chosen = (
        known.where(~split_of(F.col("_id")))
        .withColumn("_k", F.xxhash64("_id", F.lit(SEED)))
        .orderBy("_k", "_id", "y").limit(limit)
    )
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("t"))
    # at most *limit* ids
    one = (
        texts.join(F.broadcast(chosen.select("_id").distinct()), "_id", "left_semi")
        .groupBy("_id").agg(F.min(F.struct(F.xxhash64("t"), "t"))["t"].alias("t"))
    )
    rows = one.join(F.broadcast(chosen), "_id").orderBy("_k", "y").select("t", "y")
    found = rows.mapInArrow(run, "y int, b binary, s binary").toArrow()
    return [
        (y.as_py(), np.frombuffer(b.as_buffer(), "<u4"), np.frombuffer(s.as_buffer(), "<f4"))
        for y, b, s in zip(*(found.column(i) for i in range(3)))
    ]


def train(rows: list, steps: int = STEPS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """(part of the logit of each bucket, bias) from (label, buckets, shares)."""
    rng = np.random.default_rng(seed)
    total = np.bincount([y for y, *_ in rows], minlength=2) + 1.0
    data = [row for row in rows if len(row[1])]
    if min(total) <= 1 or not data:
        return np.zeros(BUCKETS), float(np.log(total[1] / total[0]))
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    layer, bias = np.zeros((2, WIDTH)), np.log(total / total.sum())
    order = chain.from_iterable(rng.permutation(len(data)) for _ in repeat(None))
    for step, i in zip(range(steps), order):
        y, b, share = data[i]
        rate = RATE * (1 - step / steps)
        held = vectors[b]
        mean = share @ held
        z = layer @ mean + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y] -= 1
        back = p @ layer
        layer -= 0.1 * rate * np.outer(p, mean)
        bias -= 0.1 * rate * p
        vectors[b] = held - (rate * share)[:, None] * back
    return vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0])


class Scorer:
    """Scores texts by one number per known word and one per pair of words."""

    def __init__(self, part: np.ndarray, bias: float):
        self.part, self.bias = part, bias
        self._clear()

    def _clear(self):
        self.numbers: dict[bytes, int] = {}
        self.sums, self.sizes = np.empty(0), np.empty(0, np.int64)
        self.hashes = np.empty(0, np.uint64)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if len(self.numbers) > CACHE_WORDS:
            self._clear()
        numbers, words = self.numbers, [t.split() for t in texts]
        new = []
        for w in chain.from_iterable(words):
            if w not in numbers:
                numbers[w] = len(numbers)
                new.append(w)
        if new:
            found, sizes = features(new)
            ends = np.cumsum(sizes)
            sums = np.add.reduceat(self.part[found], ends - sizes)
            self.sums = np.concatenate([self.sums, sums])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.hashes = np.concatenate([self.hashes, word_hashes(new)])
        counts = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(
            map(numbers.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum())
        )
        doc = np.repeat(np.arange(len(texts)), counts)
        pairs = doc[1:] == doc[:-1]
        follows = doc[1:][pairs]
        gained = self.part[pair_buckets(self.hashes[at])[pairs]]
        total = np.bincount(doc, self.sums[at], len(texts)) + np.bincount(follows, gained, len(texts))
        size = np.bincount(doc, self.sizes[at], len(texts)) + np.bincount(follows, minlength=len(texts))
        z = self.bias + total / np.maximum(size, 1)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted class."""
    spark = docs.sparkSession
    # a fixed number of buckets
    model = spark.sparkContext.broadcast(train(sample(docs, labels)))

    def run(tables: Iterator):
        import pyarrow as pa

        scorer = Scorer(*model.value)
        for table in tables:
            texts = as_bytes(table.column("t"))
            scores = [scorer.score(texts[a:b]) for a, b in batches(texts, 1 << 20)]
            yield pa.RecordBatch.from_arrays(
                [table.column("doc_id"), pa.array(np.concatenate([np.empty(0), *scores]))],
                schema=pa.schema([("doc_id", pa.int64()), ("score", pa.float64())]),
            )

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").alias("t"))
    scored = texts.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", split_of(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
