"""Removal of repeated byte strings by sorted suffixes.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts
somewhere else, in the same text or another. Sorting every suffix of a corpus
would move each byte some hundred times, so only suffixes at *anchors* are
sorted. The anchor of a string is the place, among all at which a ``GRAM`` of 32
bytes fits in, whose gram has the least hash (the first of equals). It depends
on the string alone, so equal strings have equal anchors, and a text has an
anchor about every 85 bytes.

1. Equal texts are one text; where a text comes twice all its strings repeat.
   Distinct texts are written once, bucketed by their digest, and not moved again.
2. Anchors meet by the hash of their gram; those whose gram comes once are done.
3. The others carry their surroundings, the ``LENGTH`` bytes from the anchor and
   those before it that a string can reach. Equal surroundings are one row with
   a count, so the inside of a passage that a third of all texts share is one row.
4. Rows are range-partitioned by the leading bytes of the suffix, with splitters
   sampled by Spark; rows of one gram stay together, so none are compared across
   a boundary. A bucket is sorted by multikey quicksort with characters of eight
   bytes, once by suffix and once by what lies before, read backwards. Common
   prefixes of neighbours in the two orders tell for each string over an anchor
   whether it comes again. Grams with more than ``WIDE`` rows are not sorted in
   one task: their strings are counted one by one by their digests.
5. The strings that come again give the spans to remove from each text.

Defined cases: null and empty texts have no bytes; repeated rows are texts that
come twice; ids may be null or repeat; other columns are not read; an empty
table gives no rows. Strings are judged on the input.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm.common import delete, load, materialise, new_folder
from caseweave.llm.tokens import as_bytes, batches

LENGTH = 200
GRAM = 32
#: Bytes before an anchor that a string over it can hold, and places of a gram in a string.
BEFORE = LENGTH - GRAM
PLACES = BEFORE + 1
#: Window starts that are looked at together.
CHUNK = 1 << 18
#: Rows of one gram that a task sorts.
WIDE = 200_000
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

MIX = np.uint64(0x9E3779B97F4A7C15)
TURN = np.uint64(0xD6E8FEB86659FD93)
PLACE_BITS = np.uint64(28)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each place on, by joining halves."""
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * MIX
        h = (h ^ (h >> np.uint64(29))) * TURN
        step = 1
        while step < GRAM:
            h = h[:-step] * (MIX + np.uint64(2 * step)) + h[step:]
            h ^= h >> np.uint64(31)
            step *= 2
        return h * TURN


def _sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Least of each *width* neighbours: a block's falling and the next one's rising minima."""
    n = len(v) - width + 1
    padded = np.full(-(-len(v) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, width)
    rising = np.minimum.accumulate(blocks, axis=1).ravel()
    falling = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(falling[:n], rising[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, gram hash) of all anchors in texts that lie one after the other."""
    if len(data) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    places, hashes = [], []
    low = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    for begin in range(0, len(data) - LENGTH + 1, CHUNK):
        part = data[begin : begin + CHUNK + LENGTH - 1]
        h = _gram_hashes(part)
        least = _sliding_least((h & ~low) | np.arange(len(h), dtype=np.uint64), PLACES)
        start = np.arange(begin, begin + len(least))
        whole = ends[np.searchsorted(ends, start, "right")] - start >= LENGTH
        at = (least[whole] & low).astype(np.int64)
        at = at[np.append(True, np.diff(at) != 0)[: len(at)]]
        places.append(at + begin)
        hashes.append(h[at])
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


@contextmanager
def distinct_texts(docs: DataFrame, text: str) -> Iterator[DataFrame]:
    """(key, t, copies): each text once, bucketed by key below the shared folder.

    The table is dropped and its files are deleted in the end.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    once = (
        docs.select(F.left(F.sha2(body, 256), F.lit(32)).alias("key"), body.alias("t"))
        .groupBy("key").agg(F.first("t").alias("t"), F.count("*").alias("copies"))
    )
    name, path = f"texts_{uuid.uuid4().hex}", new_folder(spark, "texts")
    try:
        (
            once.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "key")
            .option("path", path).option("compression", "zstd").saveAsTable(name)
        )
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, path)


def repeated_grams(texts: DataFrame) -> DataFrame:
    """(key, places, wide) per text: its anchors whose gram comes again; ``wide`` marks crowded ones."""
    blocks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entry = np.dtype([("gram", "<u8"), ("k1", ">u8"), ("k2", ">u8"), ("place", "<i4")])

    def find(tables: Iterator):
        import pyarrow as pa

        for table in tables:
            data, keys = as_bytes(table.column("t")), table.column("key").to_pylist()
            for a, b in batches(data):
                ends = np.cumsum([len(t) for t in data[a:b]])
                place, gram = anchors(np.frombuffer(b"".join(data[a:b]), np.uint8), ends)
                if not len(place):
                    continue
                owner = np.searchsorted(ends, place, "right")
                names = np.frombuffer(bytes.fromhex("".join(keys[a:b])), ">u8").reshape(-1, 2)
                x = np.empty(len(place), entry)
                x["gram"], x["k1"], x["k2"] = gram, names[owner, 0], names[owner, 1]
                x["place"] = place - np.append(0, ends)[owner]
                block = (gram % np.uint64(blocks)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                    yield pa.RecordBatch.from_pydict({
                        "block": pa.array([block[part[0]]], pa.int32()),
                        "entries": pa.array([x[part].tobytes()], pa.binary()),
                    })

    def meet(table):
        import pyarrow as pa

        x = np.frombuffer(b"".join(table.column("entries").to_pylist()), entry)
        _, of, count = np.unique(x["gram"], return_inverse=True, return_counts=True)
        again = count[of] > 1
        x, wide = x[again], count[of][again] > WIDE
        raw = np.stack([x["k1"], x["k2"]], 1).astype(">u8").tobytes().hex()
        return pa.table({
            "key": pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.string()),
            "place": pa.array(x["place"], pa.int32()), "wide": pa.array(wide),
        })

    met = (
        texts.select("key", "t").mapInArrow(find, "block int, entries binary")
        .groupBy("block").applyInArrow(meet, "key string, place int, wide boolean")
    )
    return materialise(met, "repeated-grams")


def surroundings(texts: DataFrame, places: DataFrame) -> DataFrame:
    """(key, place, wide, lead, suffix, before) per anchor, written; *before* is read backwards."""

    def cut(tables: Iterator):
        import pyarrow as pa

        for table in tables:
            out: list[list] = [[], [], [], [], []]
            for key, t, found in zip(table.column("key").to_pylist(), as_bytes(table.column("t")),
                                     table.column("found").to_pylist()):
                for x in found:
                    p = x["place"]
                    row = (key, p, x["wide"], t[p : p + LENGTH], t[max(0, p - BEFORE) : p][::-1])
                    for column, value in zip(out, row):
                        column.append(value)
                if len(out[0]) > 20_000:
                    yield batch(out)
                    out = [[], [], [], [], []]
            yield batch(out)

    def batch(out):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()),
             pa.array(out[2], pa.bool_()), pa.array(out[3], pa.binary()),
             pa.array(out[4], pa.binary())],
            names=["key", "place", "wide", "suffix", "before"],
        )

    found = places.groupBy("key").agg(F.collect_list(F.struct("place", "wide")).alias("found"))
    rows = texts.join(found, "key").select("key", "t", "found").mapInArrow(
        cut, "key string, place int, wide boolean, suffix binary, before binary"
    )
    return rows.withColumn("around", F.md5(F.concat("suffix", F.lit(b"\0"), "before", F.lit("|").cast("binary"),
                                                    F.length("before").cast("string").cast("binary"))))


def multikey_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common) of byte rows: their lexicographic order, and the length of the common
    prefix of each with the one before it in that order.

    Multikey quicksort with characters of eight bytes: rows that are equal so far are parted by
    their next character, and only those that are still equal go on. All runs of one depth are
    parted in one step.
    """
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(">u8").astype(np.uint64)
    order, run = np.arange(n), np.zeros(n, np.int64)
    open_ = np.arange(n) if n > 1 else np.empty(0, np.int64)  # places whose run is not parted yet
    for depth in range(words.shape[1]):
        if not len(open_):
            break
        w = words[order[open_], depth]
        by = np.lexsort((w, run[open_]))
        order[open_], w, r = order[open_][by], w[by], run[open_][by]
        new = np.append(True, (np.diff(r) != 0) | (np.diff(w) != 0))
        run[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        alone = new & np.append(new[1:], True)
        open_ = open_[~alone]
    common = np.zeros(n, np.int64)
    if n > 1:
        other = rows[order[1:]] != rows[order[:-1]]
        common[1:] = np.where(other.any(1), other.argmax(1), width)
    return order, common


def _classes(order: np.ndarray, common: np.ndarray, length: int) -> np.ndarray:
    """Number of the class of each row: rows with *length* equal first bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < length)
    return out


def repeats(suffix: list[bytes], before: list[bytes], copies: np.ndarray):
    """(least, most) number of bytes before the anchor in a repeated string, -1 for none."""
    n = len(suffix)
    sizes = np.array([len(s) for s in suffix])
    room = np.array([len(b) for b in before])
    right = np.frombuffer(b"".join(s.ljust(LENGTH, b"\0") for s in suffix), np.uint8).reshape(n, LENGTH)
    left = np.frombuffer(b"".join(b.ljust(BEFORE, b"\0") for b in before), np.uint8).reshape(n, BEFORE)
    by_suffix, by_before = multikey_order(right), multikey_order(left)
    least, most = np.full(n, -1), np.full(n, -1)
    for d in range(BEFORE + 1):
        fits = np.flatnonzero((room >= d) & (sizes >= LENGTH - d))
        if not len(fits):
            continue
        code = _classes(*by_suffix, LENGTH - d)[fits] * (n + 1) + _classes(*by_before, d)[fits]
        _, of = np.unique(code, return_inverse=True)
        again = fits[np.bincount(of, copies[fits])[of] > 1]
        least[again] = np.where(least[again] < 0, d, least[again])
        most[again] = d
    return least, most


def spans(rows: DataFrame) -> DataFrame:
    """(key, start, end) of the repeated strings over each anchor."""
    rows = materialise(rows, "surroundings")
    once = rows.groupBy("around").agg(
        F.first("suffix").alias("suffix"), F.first("before").alias("before"),
        F.max("wide").alias("wide"), F.count("*").alias("copies"),
    )
    once = materialise(once.withColumn("lead", F.substring("suffix", 1, GRAM)), "distinct-surroundings")

    def sort(tables: Iterator):
        import pyarrow as pa

        held = [t for t in tables if t.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            least, most = repeats(
                table.column("suffix").to_pylist(), table.column("before").to_pylist(),
                table.column("copies").to_numpy(),
            )
            yield from table.select(["around"]).append_column(
                "least", pa.array(least, pa.int32())
            ).append_column("most", pa.array(most, pa.int32())).to_batches()

    sorted_ = (
        once.where("NOT wide").repartitionByRange("lead").select("around", "suffix", "before", "copies")
        .mapInArrow(sort, "around string, least int, most int").where("least >= 0")
    )
    # grams in very many places: each string on its own
    first = F.greatest(F.lit(0), F.lit(LENGTH) - F.length("suffix"))
    last = F.length("before")
    strings = once.where(F.col("wide") & (first <= last)).select(
        "around", "copies", "suffix", "before", F.explode(F.sequence(first, last)).alias("d")
    ).select(
        "around", "copies", "d",
        F.sha2(F.concat(F.reverse(F.hex(F.substring(F.col("before"), F.lit(1), F.col("d")))),
                        F.lit("|"), F.hex(F.substring(F.col("suffix"), F.lit(1), LENGTH - F.col("d")))), 256)
        .alias("string"),
    )
    again = strings.groupBy("string").agg(F.sum("copies").alias("n")).where("n > 1")
    counted = strings.join(again, "string").groupBy("around").agg(
        F.min("d").cast("int").alias("least"), F.max("d").cast("int").alias("most")
    )
    return rows.select("key", "place", "around").join(sorted_.unionByName(counted), "around").select(
        "key", (F.col("place") - F.col("most")).alias("start"),
        (F.col("place") - F.col("least") + LENGTH).alias("end"),
    )


def cleaned(texts: DataFrame, found: DataFrame, keep: bool) -> DataFrame:
    """(key, n_removed, n_spans, kept_sha256, kept) of the texts with spans, written."""

    def remove(tables: Iterator):
        import hashlib

        import pyarrow as pa

        for table in tables:
            out: list[list] = [[], [], [], [], []]
            for key, t, cuts in zip(table.column("key").to_pylist(), as_bytes(table.column("t")),
                                    table.column("cuts").to_pylist()):
                at = runs = gone = 0
                left = []
                for start, end in sorted((c["start"], c["end"]) for c in cuts):
                    if start > at or not runs:
                        left.append(t[at:start])
                        runs += 1
                        gone += end - start
                    elif end > at:
                        gone += end - at
                    at = max(at, end)
                left.append(t[at:])
                kept = b"".join(left)
                text = kept.decode("utf-8", "ignore") if keep else None
                row = (key, gone, runs, hashlib.sha256(kept).hexdigest(), text)
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()),
                 pa.array(out[2], pa.int64()), pa.array(out[3], pa.string()),
                 pa.array(out[4], pa.string())],
                names=["key", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    cuts = found.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("cuts"))
    rows = texts.where("copies = 1").join(cuts, "key").select("key", "t", "cuts")
    return materialise(
        rows.mapInArrow(remove, "key string, n_removed long, n_spans long, kept_sha256 string, kept string"),
        "cleaned",
    )


def judged(docs: DataFrame, carry: list[str], text: str = "text", keep: bool = False) -> DataFrame:
    """Carried columns, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, ``kept``: what
    remains of the texts that lost bytes, less characters that lost some (null: all remains)."""
    with distinct_texts(docs, text) as texts:
        found = spans(surroundings(texts, repeated_grams(texts)))
        changed = cleaned(texts, found, keep)
        copies = materialise(texts.select("key", "copies"), "copies")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(c) for c in carry]).alias("_carried"),
        F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("_sha"),
    ).withColumn("key", F.left("_sha", F.lit(32)))
    known = copies.join(changed, "key", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    zero = F.lit(0).cast("long")
    out = [
        "_carried.*", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(whole, F.lit(EMPTY_SHA256)).otherwise(F.coalesce("kept_sha256", "_sha"))
        .alias("kept_sha256"),
    ]
    if keep:
        out.append(F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept"))
    return rows.join(known, "key").select(*out)


def op4_suffix_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(load(spark, sf_dir, "documents"), ["doc_id"])
