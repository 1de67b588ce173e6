"""Packing documents into sequences of a fixed length by minimum bin slack.

A document's ids and an end id are cut into pieces of the sequence length only
where they are longer. Full pieces are sequences of their own. For the others
the number of pieces of each length is all that a packing needs: at most
``length - 1`` numbers, gathered on the driver. There, bin by bin, the longest
length left opens the bin and a subset-sum table over the lengths left, held as
bits of one integer, gives the fullest combination that can go with it; among
equally full ones that with the longest pieces. The combination is removed as
many times as the lengths left allow, which is the same as finding it again for
each bin, so the number of steps depends on the lengths and not on the rows.

Pieces of one length are then dealt to the bins that ask for this length, by
their place among all pieces of the length. Places come from a count in each
task plus the counts of the tasks before, so a length that many pieces have
needs no task of its own.

Defined cases: a null or empty text is a document of one id; ids and texts may
repeat or be null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseweave.llm.common import load, stored
from caseweave.llm.tokens import CACHE_WORDS, as_bytes, batches, default_vocabulary, worker_encoder

LENGTH = 2048
END_ID = 0


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID,
           id_col: str = "doc_id", text: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """(doc_id, piece, start, length, ids, task, nth): pieces of each document; written.

    ``nth`` counts the pieces of this length in the task before this one.
    """

    def run(tables: Iterator):
        import pyarrow as pa
        from pyspark import TaskContext

        kinds = pa.schema([
            ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
            ("length", pa.int64()), ("ids", pa.binary()), ("task", pa.int32()), ("nth", pa.int64()),
        ])
        encoder, task = worker_encoder(vocabulary, cache_words), TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)
        for table in tables:
            texts, names = as_bytes(table.column("t")), table.column("d")
            for a, b in batches(texts):
                ids, sizes = encoder.encode(texts[a:b])
                # an end id behind each document
                ids = np.insert(ids, np.cumsum(sizes), np.uint32(end_id)).astype("<u4", copy=False)
                sizes = sizes + 1
                number = -(-sizes // length)
                doc = np.repeat(np.arange(b - a), number)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                start = piece * length
                size = np.minimum(length, sizes[doc] - start)
                at = (np.cumsum(sizes) - sizes)[doc] + start
                order = np.argsort(size, kind="stable")
                run_of = size[order]
                first = np.searchsorted(run_of, run_of, "left")
                nth = np.empty(len(size), np.int64)
                nth[order] = np.arange(len(size)) - first + seen[run_of]
                seen += np.bincount(size, minlength=length + 1)
                offsets = np.append(at, len(ids)) * 4
                raw = pa.BinaryArray.from_buffers(
                    pa.binary(), len(at),
                    [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)],
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        names.slice(a, b - a).take(pa.array(doc)), pa.array(piece, pa.int32()),
                        pa.array(start), pa.array(size), raw,
                        pa.array(np.full(len(doc), task, np.int32)), pa.array(nth),
                    ],
                    schema=kinds,
                )

    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids binary, task int, nth long"
    )
    return stored(rows, "pieces")


def fullest(seed: int, lengths: list[int], left: dict[int, int], room: int) -> dict[int, int]:
    """How often to take each length, besides one *seed*, to fill *room* best.

    *lengths* falls. ``tables[i]`` has bit s set if some choice among the first i
    lengths sums to s; the table of a length taken up to c times is built by
    doubling shares. Walking the tables back prefers the longest lengths, as
    these were added last.
    """
    mask = (1 << (room + 1)) - 1
    rising = [n for n in reversed(lengths) if n <= room]
    tables, reach = [], 1
    for n in rising:
        tables.append(reach)
        most = min(left[n] - (n == seed), room // n)
        share = 1
        while most > 0:
            take = min(share, most)
            reach |= (reach << (n * take)) & mask
            most -= take
            share *= 2
    rest = reach.bit_length() - 1
    chosen = {seed: 1}
    for n, before in zip(reversed(rising), reversed(tables)):
        most = min(left[n] - (n == seed), rest // n)
        for k in range(most, -1, -1):
            if before >> (rest - k * n) & 1:
                break
        if k:
            chosen[n] = chosen.get(n, 0) + k
            rest -= k * n
    return chosen


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, dict[int, int]]]:
    """(bins, pieces of each length in such a bin) for the given numbers of pieces."""
    left = {n: c for n, c in counts.items() if c > 0}
    out = []
    while left:
        lengths = sorted(left, reverse=True)
        seed = lengths[0]
        chosen = fullest(seed, lengths, left, length - seed)
        times = min(left[n] // k for n, k in chosen.items())
        out.append((times, chosen))
        for n, k in chosen.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def pack(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; see ``pieces``."""
    spark = cut.sparkSession
    held = cut.groupBy("task", "length").agg(F.count("*").alias("_n"))
    # at most one number per length
    counts = {
        r["length"]: r["n"]
        for r in held.where(F.col("length") < length).groupBy("length")
        .agg(F.sum("_n").alias("n")).collect()
    }
    # one entry per length and kind of bin, of which a bin of 2,048 has at most 63:
    # which places the kind asks for, its first sequence, pieces of the length in it, offset
    asked: dict[int, list] = {n: [] for n in counts}
    first, place = 0, dict.fromkeys(counts, 0)
    for times, chosen in plan(counts, length):
        at = 0
        for n in sorted(chosen, reverse=True):
            asked[n].append((place[n], first, chosen[n], at))
            place[n] += times * chosen[n]
            at += n * chosen[n]
        first += times
    shared = spark.sparkContext.broadcast(
        {n: np.array(v, np.int64).reshape(-1, 4) for n, v in asked.items()}
    )
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    n_bins = first

    def place_batch(frames: Iterator):
        import pandas as pd

        for f in frames:
            size, nth = f["length"].to_numpy(), f["_place"].to_numpy()
            # full pieces are numbered after the bins
            sequence, offset = n_bins + nth, np.zeros(len(f), np.int64)
            order = np.argsort(size, kind="stable")
            bounds = np.flatnonzero(np.diff(size[order])) + 1
            for rows in np.split(order, bounds):
                if len(rows) and size[rows[0]] < length:
                    kinds = shared.value[int(size[rows[0]])]
                    k = kinds[np.searchsorted(kinds[:, 0], nth[rows], "right") - 1]
                    bin_, inner = np.divmod(nth[rows] - k[:, 0], k[:, 2])
                    sequence[rows] = k[:, 1] + bin_
                    offset[rows] = k[:, 3] + inner * size[rows]
            f = f.drop(columns="_place")
            yield f.assign(sequence_id=pd.Series(sequence, f.index), offset=pd.Series(offset, f.index))

    rows = cut.join(bases, ["task", "length"]).withColumn("_place", F.col("_base") + F.col("nth"))
    rows = rows.drop("task", "nth", "_base")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_place").schema)
    return rows.mapInPandas(place_batch, kind + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the pieces of each sequence one after the other."""
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_parts"),
    ).select(
        "sequence_id", "n_tokens",
        F.aggregate("_parts", F.lit(b""), lambda x, p: F.concat(x, p["ids"])).alias("ids"),
    )


def packed_documents(docs: DataFrame, vocabulary: str, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Per piece: document, piece, start, length, crc32 of its ids, sequence and offset."""
    cut = pieces(docs, vocabulary, cache_words=cache_words).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(cut)


def op10_min_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(load(spark, sf_dir, "documents"), default_vocabulary())
