"""Exact Jaccard join of word n-gram sets, as a blocked sparse product.

Think of a matrix with a row per document and a column per n-gram. The overlap
of two documents is an entry of the matrix times its transpose, and is summed
up column by column. Three bounds keep the product small:

* Documents with equal sets are one class, and one row.
* Two sets with similarity 0.8 or more have sizes within a ratio of 0.8.
* If the columns have one order for all, such sets share a column among the
  first ``n - ceil(0.8 n) + 1`` of each, so only that part of a row is
  multiplied; and a pair that meets there in too few columns cannot make up the
  rest behind it, as the part that ends earlier has all its common columns in
  the other one.

Columns come in the order of their hashes, those of many rows last. Which are
those is counted for all columns, by a short form of their hashes, in one pass;
the list that all tasks get is bounded (``MOST_HEAVY``), and any list gives right
results, as the order only has to be one and the same and no bound reads the list.
Copies of a text in several tasks are counted there more than once, which can
only change the order.

Columns are dealt into blocks by hash, rows of a block are multiplied in one
task. A column that still holds more than ``CROWD`` rows (a large group of near
copies) does not give all its pairs: its rows are compared with those that have
the fewest columns of their own, which are the nearest to what the group has in
common. Pairs that met in other columns and need crowded ones to hold the
overlap have these counted. After linked rows have been found, only rows of the column that are not
connected yet are paired, and of these only such whose columns from there on can
hold the overlap, which is part of the key (``crowd_sides``): texts that share a
template but are not similar enough do not meet. So a group of m near copies costs about m comparisons, and no link
between unconnected rows is missed. Columns with very many rows are split over
several blocks, each of which takes first rows of its own.

Pairs that pass are verified on the whole sets. N-grams are 64-bit hashes of
their words, classes 128-bit hashes of their sets.

Defined cases: words are runs of bytes other than the six white-space ones, with
A-Z in lower case; fewer words than n form one n-gram; null, empty and blank
texts have no n-gram, no link, and are their own component; repeated rows are
documents of their own; a null id is never the least and such a document gets
the least id it is linked with, or null; other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm.common import load, materialise
from caseweave.llm.components import components
from caseweave.llm.tokens import as_bytes, batches

WORDS = 5
#: Similarity 4 / 5 as two whole numbers.
OVER, UNDER = 4, 5
#: Rows of a column from which on it is ordered behind the others.
HEAVY = 8
#: Columns known as heavy in all tasks at most (the heaviest): 12 bytes each.
MOST_HEAVY = 2_000_000
#: Rows of a column up to which all its pairs are multiplied.
CROWD = 12
PIVOTS = 4
#: Ratio of the sizes at which the size buckets of a crowded column begin.
STEP_OF_SIZES = 1.05
#: Rows of one column that go to one block.
SPLIT = 200_000
BLOCK_ENTRIES = 1_000_000
#: Text bytes whose sets a task holds at once.
BATCH_BYTES = 1 << 20

MIX = np.uint64(0x9E3779B97F4A7C15)
TURN = np.uint64(0xD6E8FEB86659FD93)


def _scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * TURN
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


class Grams:
    """Sorted distinct n-gram hashes of texts."""

    class _Hashes(dict):
        def __missing__(self, word):
            import xxhash

            h = self[word] = xxhash.xxh64_intdigest(word)
            return h

    def __init__(self, words: int = WORDS, cache_words: int = 150_000):
        self.n, self.cache_words, self.hashes = words, cache_words, self._Hashes()

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.hashes) > self.cache_words:
            self.hashes.clear()
        out = []
        with np.errstate(over="ignore"):
            for t in texts:
                words = t.lower().split()
                h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
                n = min(self.n, len(h)) or 1
                rolled = np.full(max(0, len(h) - n + 1), np.uint64(n))
                for i in range(n):
                    rolled = rolled * MIX + h[i : i + len(rolled)]
                rolled = np.sort(_scrambled(rolled))
                out.append(rolled[np.append(True, rolled[1:] != rolled[:-1])[: len(rolled)]])
        return out


def class_of(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def prefix_size(n: int) -> int:
    return n - -(-OVER * n // UNDER) + 1


def short(column: np.ndarray, blocks: int) -> np.ndarray:
    """Block of a column and 32 further bits of it."""
    return ((column % np.uint64(blocks)) << np.uint64(32)) | (
        (column // np.uint64(blocks)) & np.uint64(0xFFFFFFFF)
    )


def described(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One pass over the texts, written: rows (d, n, class) per document, without class where it
    has no n-grams, and rows (block, columns, rows) that count columns."""
    blocks = _blocks(docs)

    def run(tables: Iterator):
        import pyarrow as pa

        grams, seen = Grams(), set()
        for table in tables:
            texts, ids = as_bytes(table.column("t")), table.column("d")
            for a, b in batches(texts, BATCH_BYTES):
                sets = grams.sets(texts[a:b])
                names = [class_of(s) if len(s) else None for s in sets]
                yield _batch(
                    b - a, d=ids.slice(a, b - a), n=pa.array([len(s) for s in sets], pa.int64()),
                    name=pa.array(names, pa.binary()),
                )
                first = []
                for name, s in zip(names, sets):
                    if name is not None and name not in seen:
                        seen.add(name)
                        first.append(s)
                if first:
                    column, rows = np.unique(short(np.concatenate(first), blocks), return_counts=True)
                    block = (column >> np.uint64(32)).astype(np.int64)
                    for part in np.split(
                        np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1
                    ):
                        some = np.minimum(rows[part], 255).astype(np.uint8)
                        yield _batch(
                            1, block=pa.array([block[part[0]]], pa.int32()),
                            columns=pa.array([column[part].astype(np.uint32).tobytes()], pa.binary()),
                            rows=pa.array([some.tobytes()], pa.binary()),
                        )

    def _batch(size: int, **given):
        import pyarrow as pa

        kinds = {"d": pa.int64(), "n": pa.int64(), "name": pa.binary(), "block": pa.int32(),
                 "columns": pa.binary(), "rows": pa.binary()}
        return pa.RecordBatch.from_arrays(
            [given.get(c, pa.nulls(size, kind)) for c, kind in kinds.items()], names=list(kinds)
        )

    kind = "d long, n long, name binary, block int, columns binary, rows binary"
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text).alias("t"))
    return materialise(
        rows.mapInArrow(run, kind).withColumnRenamed("name", "class"), "gram-classes"
    )


def _blocks(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _new_sets(tables: Iterator) -> Iterator[list[tuple[bytes, np.ndarray]]]:
    """(class, set) of the texts of a task, each class once, in batches."""
    grams, seen = Grams(), set()
    for table in tables:
        texts = as_bytes(table.column("t"))
        for a, b in batches(texts, BATCH_BYTES):
            fresh = []
            for s in grams.sets(texts[a:b]):
                name = class_of(s)
                if len(s) and name not in seen:
                    seen.add(name)
                    fresh.append((name, s))
            if fresh:
                yield fresh


def heavy_columns(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(short column, rows), sorted: the columns of many rows, at most ``MOST_HEAVY``."""

    def total(table):
        import pyarrow as pa

        block = np.uint64(table.column("block")[0].as_py() << 32)
        column = np.frombuffer(b"".join(table.column("columns").to_pylist()), np.uint32)
        rows = np.frombuffer(b"".join(table.column("rows").to_pylist()), np.uint8)
        names, place = np.unique(column, return_inverse=True)
        sums = np.bincount(place, rows).astype(np.int64)
        many = sums > HEAVY
        return pa.table(
            {"column": (names[many] | block).astype(np.int64), "rows": sums[many]}
        )

    totals = materialise(
        counted.select("block", "columns", "rows").groupBy("block")
        .applyInArrow(total, "column long, rows long"),
        "heavy-columns",
    )
    found = totals.orderBy(F.desc("rows"), "column").limit(MOST_HEAVY).toArrow()
    column = found.column("column").to_numpy().view(np.uint64)
    order = np.argsort(column)
    return column[order], found.column("rows").to_numpy()[order]


def product(texts: DataFrame, heavy: tuple[np.ndarray, np.ndarray], blocks: int) -> DataFrame:
    """Pairs and crowded columns, written.

    Rows are (a, b, n, m, fa, fb, common) for pairs of class numbers, with common
    null for pairs of a crowded column, and (a, n, column, rest) for rows of such a
    column. fa and fb count the heavy columns of the two, rest counts the columns of
    a row from this one on.
    """
    known = texts.sparkSession.sparkContext.broadcast(heavy)
    shorts = _blocks(texts)
    entry = np.dtype([("column", "<u8"), ("who", "<i8"), ("n", "<i4"), ("light", "<i4"),
                      ("rest", "<i4"), ("split", "?")])

    def deal(tables: Iterator):
        import pyarrow as pa

        column, rows = known.value
        for fresh in _new_sets(tables):
            parts, blocks_of = [], []
            for name, s in fresh:
                k = prefix_size(len(s))
                name_of = short(s, shorts)
                at = np.minimum(np.searchsorted(column, name_of), max(0, len(column) - 1))
                is_heavy = column[at] == name_of if len(column) else np.zeros(len(s), bool)
                light, dark, late = s[~is_heavy], s[is_heavy], at[is_heavy]
                by_rows = np.argsort(rows[late], kind="stable")[: max(0, k - len(light))]
                late = late[by_rows]
                first = np.concatenate([light[:k], dark[by_rows]])
                split = np.zeros(len(first), np.int64)
                split[len(first) - len(late) :] = rows[late] // SPLIT
                who = np.frombuffer(name, "<i8", 1)[0]
                x = np.empty(len(first), entry)
                x["column"], x["who"], x["n"], x["light"] = first, who, len(s), len(light)
                x["rest"], x["split"] = len(s) - np.arange(len(first)), split > 0
                parts.append(x)
                blocks_of.append(
                    ((first + (who % (split + 1)).astype(np.uint64) * MIX) % np.uint64(blocks))
                    .astype(np.int64)
                )
            x, block = np.concatenate(parts), np.concatenate(blocks_of)
            order = np.argsort(block, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([block[part[0]]], pa.int32()),
                    "entries": pa.array([x[part].tobytes()], pa.binary()),
                })

    def multiply(table):
        import pyarrow as pa

        x = np.frombuffer(b"".join(table.column("entries").to_pylist()), entry)
        # in a column, rows with the fewest columns of their own come first: among near copies
        # these are the ones nearest to what all have in common
        x = x[np.lexsort((x["who"], x["light"], x["column"]))]
        column = x["column"].view(np.int64)
        # copies of a class from several tasks
        x = x[np.append(True, (np.diff(column) != 0) | (np.diff(x["who"]) != 0))[: len(x)]]
        begins = np.append(True, np.diff(x["column"].view(np.int64)) != 0)[: len(x)]
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.append(starts, len(x)))
        # a column that is split over blocks is not whole here, whatever its size
        crowded = (sizes > CROWD) | x["split"][starts]
        a, b, star_a, star_b, crowd = [], [], [], [], []
        for m in range(2, CROWD + 1):
            s = starts[(sizes == m) & ~crowded]
            for i in range(m):
                for j in range(i + 1, m):
                    a.append(s + i)
                    b.append(s + j)
        for s, m in zip(starts[crowded], sizes[crowded]):
            crowd.append(np.arange(s, s + m))
            for p in range(min(PIVOTS, m - 1)):
                star_a.append(np.full(m - p - 1, s + p))
                star_b.append(np.arange(s + p + 1, s + m))
        kinds = pa.schema(
            [(c, pa.int64())
             for c in ("a", "b", "n", "m", "fa", "fb", "common", "column", "rest")]
        )

        def pairs(a, b, counted):
            a = np.concatenate(a) if a else np.empty(0, int)
            b = np.concatenate(b) if b else np.empty(0, int)
            near = np.minimum(x["n"][a], x["n"][b]) * np.int64(UNDER) >= (
                np.maximum(x["n"][a], x["n"][b]) * np.int64(OVER)
            )
            swap = x["who"][a] > x["who"][b]
            a, b = np.where(swap, b, a)[near], np.where(swap, a, b)[near]
            order = np.lexsort((x["who"][b], x["who"][a]))
            a, b = a[order], b[order]
            new = np.append(True, (np.diff(x["who"][a]) != 0) | (np.diff(x["who"][b]) != 0))
            first = np.flatnonzero(new[: len(a)])
            common = np.diff(np.append(first, len(a)))
            a, b = x[a[first]], x[b[first]]
            none = pa.nulls(len(first), pa.int64())
            columns = [a["who"], b["who"], a["n"], b["n"], a["n"] - a["light"], b["n"] - b["light"]]
            return pa.table(
                [pa.array(c.astype(np.int64)) for c in columns]
                + [pa.array(common, pa.int64()) if counted else none, none, none], schema=kinds,
            )

        r = x[np.concatenate(crowd)] if crowd else x[:0]
        none = pa.nulls(len(r), pa.int64())
        columns = [r["who"], r["n"], r["column"].view(np.int64), r["rest"]]
        who, n, of, rest = (pa.array(c.astype(np.int64)) for c in columns)
        held = pa.table([who, none, n, none, none, none, none, of, rest], schema=kinds)
        return pa.concat_tables([pairs(a, b, True), pairs(star_a, star_b, False), held])

    kind = ("a long, b long, n long, m long, fa long, fb long, common long, column long, "
            "rest long")
    return materialise(
        texts.mapInArrow(deal, "block int, entries binary")
        .groupBy("block").applyInArrow(multiply, kind),
        "gram-product",
    )


def gathered(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(who, class, grams) of the wanted class numbers, each class once, written."""
    # a table, so that the planner sees its size
    wanted = materialise(wanted.select("who"), "gram-wanted")

    def gather(tables: Iterator):
        import pyarrow as pa

        for fresh in _new_sets(tables):
            who = [np.frombuffer(name, "<i8", 1)[0] for name, _ in fresh]
            yield pa.RecordBatch.from_pydict({
                "who": pa.array(who, pa.int64()),
                "class": pa.array([name for name, _ in fresh], pa.binary()),
                "grams": pa.array([s.tobytes() for _, s in fresh], pa.binary()),
            })

    rows = texts.mapInArrow(gather, "who long, class binary, grams binary")
    some = rows.join(wanted, "who", "left_semi")
    return materialise(some.dropDuplicates(["class"]), "gram-sets")


def verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b) as classes, written: pairs (a, b) of class numbers whose sets are similar enough."""

    def compare(batches_: Iterator):
        import pyarrow as pa

        for batch in batches_:
            names = [batch.column(c).to_pylist() for c in ("ca", "cb", "ga", "gb")]
            a, b = [], []
            for ca, cb, ga, gb in zip(*names):
                x, y = np.frombuffer(ga, np.uint64), np.frombuffer(gb, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both * UNDER >= OVER * (len(x) + len(y) - both):
                    a.append(ca)
                    b.append(cb)
            yield pa.RecordBatch.from_pydict(
                {"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())}
            )

    def side(x: str) -> DataFrame:
        return sets.select(
            F.col("who").alias(x), F.col("class").alias(f"c{x}"), F.col("grams").alias(f"g{x}")
        )

    both = (
        pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
        .select("ca", "cb", "ga", "gb")
    )
    return materialise(both.mapInArrow(compare, "a binary, b binary"), "gram-links")


def _labels(stars: DataFrame) -> DataFrame:
    """(who, label) of linked classes, by class number, written; *stars* as of :func:`_joined`."""

    def numbers(batches_: Iterator):
        import pyarrow as pa

        for batch in batches_:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([np.frombuffer(x, "<i8", 1)[0] for x in batch.column("a").to_pylist()], pa.int64()),
                    batch.column("b"),
                ],
                names=["who", "label"],
            )

    roots = stars.select(F.col("b").alias("a"), "b").distinct()
    return materialise(
        stars.unionByName(roots).mapInArrow(numbers, "who long, label binary"), "gram-labels"
    )


def _joined(stars: DataFrame | None, found: DataFrame) -> DataFrame:
    """Links (a, b) of each class to the least of its component, from such links and further ones."""
    both = found if stars is None else stars.unionByName(found)
    return components(both).where("node <> component").select(
        F.col("node").alias("a"), F.col("component").alias("b")
    )


def _apart(pairs: DataFrame, labels: DataFrame, *more: str) -> DataFrame:
    """The pairs whose ends are not connected yet."""
    la = labels.select(F.col("who").alias("a"), F.col("label").alias("la"))
    lb = labels.select(F.col("who").alias("b"), F.col("label").alias("lb"))
    return pairs.join(la, "a", "left").join(lb, "b", "left").where(
        F.coalesce(F.col("la") != F.col("lb"), F.lit(True))
    ).select("a", "b", *more)


def crowd_sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (column, who, n, rest, label) as the smaller and as the larger row of a pair, keyed by
    column and the size buckets of both.

    A pair needs n + m <= 9/4 rest of either row, so its smaller row alone holds enough for two of
    its own size, and its partners are in the buckets up to what it holds. Rows that have only a
    part of their columns in common with a crowd meet no other such row.
    """
    def bucket(size):
        return F.floor(F.log(size.cast("double")) / math.log(STEP_OF_SIZES)).cast("int")

    n = F.col("n")
    room = F.floor((OVER + UNDER) * F.col("rest") / OVER).cast("long") - n
    up = F.least(room, F.floor(n * UNDER / OVER).cast("long"))
    down, top = F.ceil(n * OVER / UNDER).cast("long"), F.least(room, n)
    smaller = rows.where(up >= n).withColumn("bucket", bucket(n)).withColumn(
        "bucket_b", F.explode(F.sequence(bucket(n), bucket(up)))
    )
    larger = rows.where(top >= down).select(
        "column", F.col("who").alias("b"), F.col("label").alias("other"), F.col("n").alias("m"),
        F.col("rest").alias("rest_b"), bucket(n).alias("bucket_b"),
        F.explode(F.sequence(bucket(down), bucket(top))).alias("bucket"),
    )
    return smaller, larger


def links(docs: DataFrame, described_docs: DataFrame, text: str = "text") -> DataFrame:
    """(a, b): links between classes that connect all that are similar enough."""
    texts = docs.select(F.col(text).alias("t"))
    entries = described_docs.agg(F.sum("n")).first()[0] or 0
    blocks = max(_blocks(docs), math.ceil(entries / UNDER / BLOCK_ENTRIES))
    heavy = heavy_columns(described_docs.where("block IS NOT NULL"))
    made = product(texts, heavy, blocks)
    ceiling = lambda n, over, under: F.ceil(n * over / under)
    n, m, common = F.col("n"), F.col("m"), F.col("common")
    needed = ceiling(n + m, OVER, OVER + UNDER)
    rest = F.greatest(ceiling(n, OVER, UNDER), ceiling(m, OVER, UNDER)) - 1
    pair = made.where("b IS NOT NULL").groupBy("a", "b", "n", "m", "fa", "fb").agg(
        F.sum("common").alias("common"), F.max(F.col("common").isNull()).alias("star")
    )
    crowded = made.where("column IS NOT NULL").select(F.col("a").alias("who"), "column", "n", "rest")
    # either the columns that were multiplied hold enough, or crowded columns of both rows, which
    # are not in ``common``, can hold what is missing; those pairs are counted below
    crowds = materialise(
        crowded.groupBy("who").agg(F.collect_set("column").alias("columns")), "gram-crowded"
    )
    held = crowds.select("who", F.size("columns").alias("held"))
    sure = F.col("star") | (common >= needed - rest)
    pairs = materialise(
        pair.join(held.select(F.col("who").alias("a"), F.col("held").alias("ha")), "a", "left")
        .join(held.select(F.col("who").alias("b"), F.col("held").alias("hb")), "b", "left")
        .withColumn("sure", sure)
        .where(F.col("sure") | (F.col("ha").isNotNull() & F.col("hb").isNotNull()
            & (common + F.least("ha", "hb") >= needed - rest)))
        .select("a", "b", "fa", "fb", "n", "m", "sure", (needed - rest - common).alias("short")),
        "gram-candidates",
    )
    unsure, pairs = pairs.where("NOT sure"), pairs.where("sure")
    ends = pairs.select(F.col("a").alias("who")).union(pairs.select("b")).union(crowded.select("who"))
    sets = gathered(texts, ends.distinct())

    # each class with the one it meets that has the fewest columns of its own
    met = pairs.select("a", "b", (m - F.col("fb")).alias("own")).unionByName(
        pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), (n - F.col("fa")).alias("own"))
    )
    first = met.groupBy("a").agg(F.min(F.struct("own", "b"))["b"].alias("b"))
    found = verified(sets, first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    stars = _joined(None, found)
    labels = _labels(stars)

    # the other pairs whose ends are still apart
    found = verified(sets, _apart(pairs, labels))
    if not found.isEmpty():
        stars = _joined(stars, found)
        labels = _labels(stars)

    # pairs that need crowded columns, which are counted now
    both = (
        _apart(unsure, labels, "short")
        .join(crowds.select(F.col("who").alias("a"), F.col("columns").alias("x")), "a")
        .join(crowds.select(F.col("who").alias("b"), F.col("columns").alias("y")), "b")
    )
    found = verified(sets, both.where(F.size(F.array_intersect("x", "y")) >= F.col("short")))
    if not found.isEmpty():
        stars = _joined(stars, found)
        labels = _labels(stars)

    # what is left: rows of a crowded column that are still apart. In the first column that two
    # rows have in common, what either has from there on must hold the whole overlap; where that
    # column is not crowded the pair has been counted above, so any other pair that is similar
    # enough passes this bound in at least one column
    own = F.lpad(F.hex("who"), 16, "0")
    rows = materialise(
        crowded.join(labels, "who", "left").withColumn("label", F.coalesce(F.hex("label"), own)),
        "gram-crowds",
    )
    mixed = rows.groupBy("column").agg(F.min("label").alias("x"), F.max("label").alias("y"))
    rows = rows.join(mixed.where("x <> y").select("column"), "column")
    smaller, larger = crowd_sides(rows)
    apart = smaller.join(larger, ["column", "bucket", "bucket_b"]).where(
        (F.col("label") != F.col("other"))
        & ((n < m) | ((n == m) & (F.col("who") < F.col("b"))))
        & (UNDER * n >= OVER * m)
        & (F.least("rest", "rest_b") >= needed)
    ).select(F.least("who", "b").alias("a"), F.greatest("who", "b").alias("b"))
    return stars.unionByName(verified(sets, apart))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, n_shingles and component_id."""
    told = described(docs, id_col, text)
    rows = told.where("block IS NULL").select("d", "n", "class")
    joined = components(links(docs, told, text)).withColumnRenamed("node", "class")
    held = rows.join(joined, "class", "left").select(
        "d", "n", F.coalesce("component", "class").alias("key")
    )
    least = held.where("key IS NOT NULL").groupBy("key").agg(F.min("d").alias("least"))
    return held.join(least, "key", "left").select(
        F.col("d").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("least", "d").alias("component_id"),
    )


def op7_ngram_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(load(spark, sf_dir, "documents"))
