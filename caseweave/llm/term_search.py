"""Ranked lexical search: bundles of items pass through the owners of their terms.

Terms are the maximal runs of letters, digits and characters beyond ASCII, with
A-Z in lower case. The score of a document for an item is the sum, over the
item's terms, of a weight that falls with the number of documents holding the
term, times a share that grows with the term's occurrences and shrinks with the
document's length; all of it in 64-bit integers but for the logarithm.

1. Documents are read once for the vocabulary of the items. A task packs them
   into blocks and writes, per block, the lengths of its documents and one
   posting (term, document, occurrences) per term of the vocabulary found.
2. Document frequencies are summed by term and give the weights.
3. Terms are dealt to ``len(OWNERS) + 1`` owners by the share of the documents
   that hold them. A bundle is a group of items and the scores of one block's
   documents so far, kept as a sparse list. It visits the owners one after the
   other, rare terms first; each visit is a cogroup of the bundles with the
   owner's postings of the same block. So what travels between owners is the
   documents that hold rare terms; the owner of the frequent terms comes last,
   and only the best of each item leave it.
4. A ranking window per item makes the final choice from the blocks' best.

Bounds: the items whose texts fill ``PASS_BYTES`` make one pass over the
documents, and their vocabulary is what is broadcast; more items take more
passes. A block has at most ``BLOCK_DOCS`` documents (and closes after
``BLOCK_TERMS`` found occurrences, or after one longer document), a bundle
``BUNDLE`` items, so one group holds a matrix of bounded size. Blocks are cut by
the number of documents, so no term, however frequent, makes a large group.

Defined cases: a null or empty text has no terms; a document without terms is
in no count and no result. An item without terms has no rows. Each row of the
items is an item, each row of the documents a document, also where ids repeat;
null ids come last among equal scores. Very long texts are one row of a task and
are read whole. Other columns are not read. Without documents or items the
result is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseweave.llm.common import load, materialise, running_total
from caseweave.llm.tokens import as_bytes

#: Terms in less than one of so many documents belong to the first owner, the second, ...
OWNERS = (512, 64, 8)
BLOCK_DOCS = 2_048
BLOCK_TERMS = 1 << 20
BUNDLE = 256
PASS_BYTES = 8 << 20
BEST = 50

FOUND = "_item int, item_id long, doc_id long, score long"


def _letters() -> bytes:
    """Byte table: letters in lower case, digits and bytes beyond ASCII stay, all else is a blank."""
    table = bytearray(b" " * 0x80) + bytearray(range(0x80, 0x100))
    for c in b"0123456789abcdefghijklmnopqrstuvwxyz":
        table[c] = c
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[c] = c + 32
    return bytes(table)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_letters()).split()


def _postings(docs: DataFrame, doc_id: str, text: str, vocabulary) -> DataFrame:
    """Blocks of documents with their postings, written; one row is one block."""
    schema = "ids array<long>, n binary, terms binary, docs binary, tf binary, held long, words long"

    def run(tables: Iterator):
        import pyarrow as pa

        find, table = vocabulary.value.get, _letters()
        fields = pa.schema([
            ("ids", pa.list_(pa.int64())), ("n", pa.binary()), ("terms", pa.binary()),
            ("docs", pa.binary()), ("tf", pa.binary()), ("held", pa.int64()), ("words", pa.int64()),
        ])

        def block(ids, sizes, found):
            n = np.array(sizes, "<i8")
            key = np.concatenate(found) if found else np.empty(0, np.int64)
            key, tf = np.unique(key, return_counts=True)
            return pa.RecordBatch.from_pylist([{
                "ids": ids, "n": n.tobytes(),
                "terms": (key // BLOCK_DOCS).astype("<u4").tobytes(),
                "docs": (key % BLOCK_DOCS).astype("<u2").tobytes(),
                "tf": tf.astype("<u4").tobytes(),
                "held": int((n > 0).sum()), "words": int(n.sum()),
            }], schema=fields)

        ids, sizes, found, total = [], [], [], 0
        for part in tables:
            for i, body in zip(part.column("i").to_pylist(), as_bytes(part.column("t"))):
                words = body.translate(table).split()
                hits = np.fromiter(map(find, words, repeat(-1)), np.int64, len(words))
                hits = hits[hits >= 0]
                found.append(hits * BLOCK_DOCS + len(ids))
                ids.append(i)
                sizes.append(len(words))
                total += len(hits)
                if len(ids) == BLOCK_DOCS or total >= BLOCK_TERMS:
                    yield block(ids, sizes, found)
                    ids, sizes, found, total = [], [], [], 0
        if ids:
            yield block(ids, sizes, found)

    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"))
    blocks = rows.mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id())
    return materialise(blocks, "postings")


def _counts(blocks: DataFrame) -> dict[int, int]:
    """Documents that hold each term (by number), documents with terms (-1) and all terms (-2)."""

    def run(tables: Iterator):
        import pyarrow as pa

        for part in tables:
            for terms, held, words in zip(*(part.column(i).to_pylist() for i in range(3))):
                term, n = np.unique(np.frombuffer(terms, "<u4").astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(term, [-1, -2])), pa.array(np.append(n, [held, words]))],
                    names=["term", "n"],
                )

    counted = blocks.select("terms", "held", "words").mapInArrow(run, "term long, n long")
    # at most the vocabulary of a pass
    return {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def _items_by_term(terms: list[list[int]], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per bundle: starts of each term's items (by term number), and the items in the bundle."""
    out = []
    for first in range(0, len(terms), BUNDLE):
        pairs = [(t, i) for i, held in enumerate(terms[first : first + BUNDLE]) for t in held]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        starts = np.searchsorted(table[:, 0], np.arange(size + 1))
        out.append((starts, table[:, 1]))
    return out


def _visit(bundles: DataFrame, blocks: DataFrame, model, owner: int, last: bool, best: int) -> DataFrame:
    """Bundles after one owner has added its terms; after the last owner the best of each item."""

    def pick(tables: Iterator):
        import pyarrow as pa

        m = model.value
        for part in tables:
            for block, terms, docs, tf in zip(*(part.column(i).to_pylist() for i in range(4))):
                term = np.frombuffer(terms, "<u4")
                mine = m["owner"][term] == owner
                term, docs, tf = (
                    term[mine], np.frombuffer(docs, "<u2")[mine], np.frombuffer(tf, "<u4")[mine]
                )
                for number, (starts, _) in enumerate(m["items"]):
                    asked = starts[term + 1] > starts[term]
                    if asked.any():
                        yield pa.RecordBatch.from_pylist([{
                            "bundle": number, "block": block, "terms": term[asked].tobytes(),
                            "docs": docs[asked].tobytes(), "tf": tf[asked].tobytes(),
                        }], schema=pa.schema([
                            ("bundle", pa.int32()), ("block", pa.int64()), ("terms", pa.binary()),
                            ("docs", pa.binary()), ("tf", pa.binary()),
                        ]))

    def add(bundle, postings):
        import pyarrow as pa

        m, row = model.value, bundle.to_pylist()[0]
        n = np.frombuffer(row["n"], "<i8")
        starts, items = m["items"][row["bundle"]]
        count = min(BUNDLE, m["count"] - row["bundle"] * BUNDLE)
        scores = np.zeros((count, len(n)), np.int64)
        scores.ravel()[np.frombuffer(row["places"], "<u4")] = np.frombuffer(row["scores"], "<i8")
        length = 50 + (50 * n * m["N"]) // m["L"]
        for found in postings.to_pylist():
            term = np.frombuffer(found["terms"], "<u4").astype(np.int64)
            docs = np.frombuffer(found["docs"], "<u2").astype(np.int64)
            tf = np.frombuffer(found["tf"], "<u4").astype(np.int64)
            gain = m["weight"][term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * length[docs]))
            cuts = np.flatnonzero(np.diff(term)) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(term))):
                asking = items[starts[term[a]] : starts[term[a] + 1]]
                scores[np.ix_(asking, docs[a:b])] += gain[a:b]
        if not last:
            places = np.flatnonzero(scores)
            return pa.table({
                "bundle": pa.array([row["bundle"]], pa.int32()), "block": pa.array([row["block"]]),
                "ids": pa.array([row["ids"]], pa.list_(pa.int64())), "n": pa.array([row["n"]]),
                "places": pa.array([places.astype("<u4").tobytes()]),
                "scores": pa.array([scores.ravel()[places].tobytes()]),
            })
        ids = np.array([2**63 - 1 if i is None else i for i in row["ids"]], np.int64)
        who, which = [], []
        for item, got in enumerate(scores):
            some = np.flatnonzero(got > 0)
            if len(some) > best:
                floor = np.partition(got[some], len(some) - best)[len(some) - best]
                some = some[got[some] >= floor]
            some = some[np.lexsort((ids[some], -got[some]))][:best]
            who.append(np.full(len(some), item))
            which.append(some)
        who, which = np.concatenate([np.empty(0, int), *who]), np.concatenate([np.empty(0, int), *which])
        number = who + row["bundle"] * BUNDLE
        return pa.table({
            "_item": pa.array(number, pa.int32()),
            "item_id": pa.array([m["ids"][i] for i in number], pa.int64()),
            "doc_id": pa.array([row["ids"][i] for i in which], pa.int64()),
            "score": pa.array(scores[who, which], pa.int64()),
        })

    owned = blocks.select("block", "terms", "docs", "tf").mapInArrow(
        pick, "bundle int, block long, terms binary, docs binary, tf binary"
    )
    keys = ["bundle", "block"]
    schema = FOUND if last else bundles.schema
    return bundles.groupBy(*keys).cogroup(owned.groupBy(*keys)).applyInArrow(add, schema)


def _one_pass(docs: DataFrame, items: list, doc_id: str, text: str, best: int) -> DataFrame | None:
    """The best documents of each block for *items*, (id, text) rows of bounded size."""
    spark = docs.sparkSession
    numbers: dict[bytes, int] = {}
    terms = [
        sorted({numbers.setdefault(t, len(numbers)) for t in terms_of((r["t"] or "").encode())})
        for r in items
    ]
    if not numbers:
        return None
    # at most the terms of PASS_BYTES of text
    blocks = _postings(docs, doc_id, text, spark.sparkContext.broadcast(numbers))
    counts = _counts(blocks)
    held, words = counts.get(-1, 0), counts.get(-2, 0)
    if not held:
        return None
    frequency = np.array([counts.get(i, 0) for i in range(len(numbers))])
    weight = [math.floor(1000 * math.log((2 * held + 2) / (2 * f + 1))) for f in frequency.tolist()]
    owner = sum((frequency * share >= held).astype(int) for share in OWNERS)
    model = spark.sparkContext.broadcast({
        "N": held, "L": words, "weight": np.array(weight, np.int64), "owner": owner,
        "items": _items_by_term(terms, len(numbers)), "ids": [r["i"] for r in items],
        "count": len(items),
    })
    none = F.lit(b"").alias
    bundles = blocks.select(
        F.explode(F.sequence(F.lit(0), F.lit((len(items) - 1) // BUNDLE))).alias("bundle"),
        "block", "ids", "n", none("places"), none("scores"),
    )
    for number in range(len(OWNERS) + 1):
        bundles = _visit(bundles, blocks, model, number, number == len(OWNERS), best)
    return bundles


def search(
    docs: DataFrame, items: DataFrame, best: int = BEST, doc_id: str = "doc_id", item_id: str = "item_id",
    text: str = "text", pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id and score of the *best* documents with a score above 0 of each item."""
    spark = docs.sparkSession
    asked = running_total(
        items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")),
        [], ["i", "t"], F.octet_length(F.coalesce("t", F.lit(""))) + 1, "_at",
    ).withColumn("_pass", F.floor(F.col("_at") / pass_bytes).cast("int"))
    asked = materialise(asked, "items")
    ranked = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for number in range((asked.agg(F.max("_pass")).first()[0] or 0) + 1):
        found = _one_pass(
            docs, asked.where(F.col("_pass") == number).orderBy("_at").collect(), doc_id, text, best
        )
        if found is not None:
            out = out.unionByName(
                found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= best)
                .select("item_id", "rank", "doc_id", "score")
            )
    return out


def op12_term_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term FROM documents),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
len AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY r),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT row_number() OVER () AS i, item_id, unnest(list_distinct(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9A-Za-z\x{80}-\x{10FFFF}]+'))) AS term FROM benchmark),
w AS (SELECT i, item_id, term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM q JOIN df USING (term), total),
m AS (SELECT r, 100 - 50 + ((50 * n * docs) // terms) AS m FROM len, total),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM w JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank
      FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""
