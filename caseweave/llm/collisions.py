"""Near duplicates of embeddings by counting collisions of one-dimensional projections.

1. Vectors with the same components are one class; null, zero and non-finite
   vectors are left out and link with nothing. Classes are compared from here.
2. Classes that are crowded together are gathered around one of them, the centre, as a
   group: all within ``half`` the angle of the threshold, so that each links with each
   by the triangle inequality and the pairs in a group need not be written. Centres are the
   least rows of segments with over ``CROWD`` rows. All other classes are groups of one.
3. Each of ``tables`` tables sorts the classes by one random projection, inside
   segments that the signs of ``bits`` further projections name; bits grow with
   the logarithm of the number of classes, so a segment keeps its size. One
   range partitioning by (table, segment, projection) is that sort: splitters
   come from a sample, and rows just above a splitter are also sent to the
   partition below, so that windows run across boundaries and a crowded segment
   is spread like any other. Of the rows of one group within one window's width only
   the outermost two travel: whatever is in reach of a row between them is in reach of one of them.
4. A window around each row, ``WINDOW`` standard deviations of the projected
   difference of two vectors at the threshold wide, gives its collisions in the
   table, as pairs of groups.
5. Pairs that collide in at least ``needed`` tables are compared in double
   precision. ``needed`` is the largest count that a pair at the threshold
   reaches with probability ``RECALL``, by the binomial distribution of its
   collisions; the number of tables is the least for which that count is 2 or more.
   Two groups of one are compared themselves. Of larger ones, centres and radii tell whether all
   members link or none; where neither is certain, members are compared in blocks of ``BLOCK`` x
   ``BLOCK`` by matrix products, which give a count per member and one link for the groups.

Links between classes then count for all their members: a member is linked to
the other members of its class and to all members of linked classes.

Widths are few and are compared one after the other; only vectors of one width link.

Defined cases: null, zero or non-finite vectors have 0 links and are their own
component; rows with the same vec_id
stay rows; a null vec_id has a null component unless a linked row has an id;
labels and other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm.common import load, materialise
from caseweave.llm.components import components

THRESHOLD = 0.95
RECALL = 0.999
WINDOW = 2.0
#: Classes that the signs leave in a segment on average, were they spread evenly.
SEGMENT = 16
#: Rows of a segment above which groups are looked for in it, and how many sets of segments are tried.
CROWD = 4 * SEGMENT
TRIALS = 3
#: Members of two groups that one matrix product compares.
BLOCK = 1024
#: Angles closer to a bound than this are not decided by the triangle inequality.
SLACK = 1e-6
#: Rows of all tables that a partition should get, and rows sampled for the splitters.
PART_ROWS = 400_000
SAMPLE_ROWS = 200_000
SEED = 11


def _at_least(n: int, p: float, c: int) -> float:
    return 1 - sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(c))


def calibrated(n: int, threshold: float = THRESHOLD, recall: float = RECALL):
    """(bits, tables, needed) for *n* classes."""
    bits = max(0, math.ceil(math.log2(max(1, n / SEGMENT))))
    same_side = 1 - math.acos(threshold) / math.pi
    p = same_side**bits * math.erf(WINDOW / math.sqrt(2))
    tables = 2
    while _at_least(tables, p, 2) < recall:
        tables += 1
    # a few more tables allow a higher count, which drops most pairs that meet by chance
    tables = math.ceil(1.5 * tables)
    needed = 2
    while _at_least(tables, p, needed + 1) >= recall:
        needed += 1
    return bits, tables, needed


def _normed(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with class, classes (class, vector, size)), written.

    The class of a usable vector is a 128-bit digest of its components.
    """
    vector = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    usable = F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))
    # 0.0 and -0.0 are one component
    text = F.concat_ws(",", F.transform(vector, lambda x: (x + F.lit(0.0)).cast("string")))
    held = materialise(
        rows.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.when(usable, F.md5(text)).alias("class"),
            F.when(usable, vector).alias("v"),
        ),
        "vectors",
    )
    grouped = held.where("class IS NOT NULL").groupBy("class").agg(
        F.first("v").alias("v"), F.count("*").alias("size"), F.min("vec_id").alias("least")
    )
    numbered = materialise(
        grouped.withColumn("c", F.monotonically_increasing_id()), "vector-classes"
    )
    return held, numbered


def _vectors(column, width: int) -> np.ndarray:
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def crowds(numbered: DataFrame, n: int, width: int, threshold: float = THRESHOLD) -> DataFrame:
    """(c, ball, angle) of the classes gathered around another one, or around themselves; written.

    *numbered* holds *n* classes of one *width*. ``ball`` is the number of the centre.
    """
    bits = calibrated(n, threshold)[0]
    half = math.acos(threshold) / 2 - SLACK

    def segments(batches_: Iterator):
        import pyarrow as pa

        lines = np.random.default_rng(SEED + 1).standard_normal((width, TRIALS * bits))
        for batch in batches_:
            side = (_normed(_vectors(batch.column("v"), width)) @ lines > 0).reshape(batch.num_rows, TRIALS, bits)
            name = side @ (1 << np.arange(bits, dtype=np.int64)) * TRIALS + np.arange(TRIALS)
            yield pa.RecordBatch.from_pydict({
                "c": np.repeat(batch.column("c").to_numpy(), TRIALS),
                "segment": name.astype(np.int64).ravel(),
            })

    def gather(batches_: Iterator):
        import pyarrow as pa

        for batch in batches_:
            if batch.num_rows:
                cos = (_normed(_vectors(batch.column("v"), width))
                       * _normed(_vectors(batch.column("w"), width))).sum(axis=1)
                angle = np.arccos(np.clip(cos, -1, 1))
                near = angle <= half
                yield pa.RecordBatch.from_pydict({
                    "c": batch.column("c").to_numpy()[near], "ball": batch.column("ball").to_numpy()[near],
                    "angle": angle[near],
                })

    rows = numbered.select("c", "v").mapInArrow(segments, "c long, segment long")
    least = rows.groupBy("segment").agg(F.min("c").alias("ball"), F.count("*").alias("n"))
    least = least.where(F.col("n") > CROWD).select("segment", "ball")
    tried = rows.join(least, "segment").select("c", "ball").distinct()
    both = tried.join(numbered.select("c", "v"), "c").join(
        numbered.select(F.col("c").alias("ball"), F.col("v").alias("w")), "ball"
    ).select("c", "ball", "v", "w")
    # a common order of the centres, so that the segments of one crowd agree on few of them
    first = both.mapInArrow(gather, "c long, ball long, angle double").groupBy("c").agg(
        F.min("ball").alias("ball"), F.min_by("angle", "ball").alias("angle")
    )
    return materialise(first, "vector-crowds")


def candidates(
    gathered: DataFrame, n: int, width: int, threshold: float = THRESHOLD, seed: int = SEED
) -> DataFrame:
    """(a, b): pairs of groups, of *n* classes of one width, that collide often enough.

    *gathered* holds c, class, v, ball and ``crowded``, false for a group of one.
    """
    bits, tables, needed = calibrated(n, threshold)
    # projected onto a standard normal direction, vectors at the threshold differ by a normal
    # number with this deviation
    reach = WINDOW * math.sqrt(2 - 2 * threshold)
    lane = 64.0  # more than the range of projections: keys of two segments are never close

    def keys(vectors: np.ndarray) -> np.ndarray:
        """Sort key of each vector in each table: table, segment, projection as one number."""
        rng = np.random.default_rng(seed)
        lines = rng.standard_normal((tables, width, bits + 1))
        u = _normed(vectors)
        out = np.empty((len(u), tables))
        for t in range(tables):
            along = u @ lines[t]
            segment = (along[:, 1:] > 0) @ (1 << np.arange(bits)) + (t << bits)
            out[:, t] = segment * lane + np.clip(along[:, 0], -30, 30)
        return out

    wanted = max(1, min(SAMPLE_ROWS // tables, n))
    some = gathered.orderBy(F.xxhash64("class")).limit(wanted).select("v").toArrow()
    ranked = np.sort(keys(_vectors(some.column("v"), width)).ravel())
    n_parts = max(1, math.ceil(n * tables / PART_ROWS), int(
        gathered.sparkSession.sparkContext.defaultParallelism
    ))
    splitters = np.unique(ranked[np.arange(1, n_parts) * len(ranked) // n_parts])

    def outermost(part, key, ball, own, crowded) -> np.ndarray:
        """Which rows stay: of a crowded group, the least and the greatest of each stretch of keys."""
        some = np.flatnonzero(crowded)
        if not len(some):
            return np.arange(len(key))
        stretch = np.floor(key[some] / reach)
        some = some[np.lexsort((key[some], own[some], stretch, ball[some], part[some]))]
        stretch = np.floor(key[some] / reach)
        new = np.ones(len(some) + 1, bool)
        new[1:-1] = (
            (np.diff(stretch) != 0) | (np.diff(ball[some]) != 0) | (np.diff(part[some]) != 0)
            | (own[some][1:] != own[some][:-1])
        )
        return np.concatenate((np.flatnonzero(~crowded), some[new[:-1] | new[1:]]))

    names = ("part", "key", "ball", "own", "crowded")

    def deal(batches_: Iterator):
        import pyarrow as pa

        for batch in batches_:
            key = keys(_vectors(batch.column("v"), width)).ravel()
            home = np.searchsorted(splitters, key, "right")
            lowest = np.searchsorted(splitters, key - reach, "right")
            copies = home - lowest + 1
            row = np.repeat(np.arange(len(key)), copies)
            part = np.repeat(home, copies) - (
                np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            )
            dealt = (
                part.astype(np.int32), key[row], batch.column("ball").to_numpy()[row // tables],
                part == home[row], batch.column("crowded").to_numpy(zero_copy_only=False)[row // tables],
            )
            stay = outermost(*dealt)
            yield pa.RecordBatch.from_pydict({n: x[stay] for n, x in zip(names, dealt, strict=True)})

    def meet(tables_: Iterator):
        import pyarrow as pa

        held = [t for t in tables_ if t.num_rows]
        if not held:
            return
        rows = [
            np.concatenate([t.column(n).to_numpy(zero_copy_only=False) for t in held]) for n in names
        ]
        stay = outermost(*rows)
        part, key, ball, own, crowded = (x[stay] for x in rows)
        for p in np.unique(part):
            here = np.flatnonzero(part == p)
            here = here[np.lexsort((~own[here], key[here]))]
            k, w, o, many = key[here], ball[here], own[here], crowded[here]
            table = np.floor(k / lane + 0.5).astype(np.int64) >> bits
            # rows of the partition above serve as neighbours only
            last = np.searchsorted(k, k + reach, "right")
            count = np.where(o, last - np.arange(len(k)) - 1, 0)
            total = np.cumsum(count)
            begin = 0
            while begin < len(k):
                end = max(begin + 1, int(np.searchsorted(
                    total, (total[begin - 1] if begin else 0) + 2_000_000, "right")))
                c = count[begin:end]
                a = np.repeat(np.arange(begin, begin + len(c)), c)
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c)
                apart = w[a] != w[b]
                a, b = a[apart], b[apart]
                x, y = np.minimum(w[a], w[b]), np.maximum(w[a], w[b])
                # groups meet once in a table here, however many rows of theirs do; where they also
                # meet elsewhere they count twice, which only adds to what is compared
                groups = many[a] | many[b]
                met = np.unique(np.stack((x[groups], y[groups], table[a][groups])), axis=1)
                yield pa.RecordBatch.from_pydict({
                    "a": np.concatenate((x[~groups], met[0])), "b": np.concatenate((y[~groups], met[1])),
                })
                begin = end

    dealt = gathered.select("v", "ball", "crowded").mapInArrow(
        deal, "part int, key double, ball long, own boolean, crowded boolean"
    )
    met = dealt.repartition(n_parts, "part").mapInArrow(meet, "a long, b long")
    return met.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= needed).select(
        "a", "b"
    )


def compared(gathered: DataFrame, pairs: DataFrame, width: int, threshold: float) -> DataFrame:
    """(a, b, whole) of the pairs of groups that link: whole, or perhaps in part; written."""
    theta = math.acos(threshold)

    def compare(batches_: Iterator):
        import pyarrow as pa

        for batch in batches_:
            if batch.num_rows:
                u, w = (_normed(_vectors(batch.column(n), width)) for n in ("va", "vb"))
                cos = (u * w).sum(axis=1)
                spread = batch.column("ra").to_numpy() + batch.column("rb").to_numpy()
                angle = np.arccos(np.clip(cos, -1, 1))
                whole = np.where(spread > 0, angle + spread <= theta - SLACK, cos >= threshold)
                part = (spread > 0) & ~whole & (angle - spread <= theta + SLACK)
                stay = whole | part
                yield pa.RecordBatch.from_pydict({
                    "a": batch.column("a").to_numpy()[stay], "b": batch.column("b").to_numpy()[stay],
                    "whole": whole[stay],
                })

    radius = gathered.where("crowded").groupBy("ball").agg(
        # never 0 for a crowd, and larger than what arccos may be off
        (F.max("angle") + SLACK).alias("r")
    )
    centres = gathered.select(F.col("c").alias("ball"), "v").join(radius, "ball", "left").select(
        "ball", "v", F.coalesce("r", F.lit(0.0)).alias("r")
    )
    both = pairs
    for x in ("a", "b"):
        both = both.join(centres.toDF(x, f"v{x}", f"r{x}"), x)
    return materialise(
        both.select("a", "b", "va", "vb", "ra", "rb").mapInArrow(compare, "a long, b long, whole boolean"),
        "vector-groups",
    )


def counted(gathered: DataFrame, parts: DataFrame, width: int, threshold: float) -> DataFrame:
    """(c, others, ball, other) for pairs (a, b) of groups that may link in part; written.

    ``others`` is how many vectors of the other group a member links with in one block; ``other``
    is the group linked with. The members of the smaller group of a pair are set against the
    larger one's, together with those of all its other partners, in blocks of both.
    """
    members = gathered.select("ball", "c", "v", "size")
    sizes = gathered.groupBy("ball").agg(F.count("*").alias("n"))
    sized = parts.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    larger = F.col("na") >= F.col("nb")
    sides = sized.select(
        F.when(larger, F.col("a")).otherwise(F.col("b")).alias("home"),
        F.when(larger, F.col("b")).otherwise(F.col("a")).alias("ball"),
        F.greatest("na", "nb").alias("n_home"), F.least("na", "nb").alias("n_guest"),
    )
    blocks = sides.groupBy("home").agg(
        F.ceil(F.max("n_home") / BLOCK).cast("int").alias("down"),
        F.ceil(F.sum("n_guest") / BLOCK).cast("int").alias("across"),
    )
    block = F.pmod(F.xxhash64("c", F.col("home")), F.col("n")).cast("int")

    def dealt(rows: DataFrame, own: str, other: str, guest: bool) -> DataFrame:
        name, every = ("j", "i") if guest else ("i", "j")
        spread = rows.withColumn("n", F.col(own)).withColumn(name, block)
        return spread.withColumn(every, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select(
            "home", "i", "j", F.lit(guest).alias("guest"), "ball", "c", "size", "v"
        )

    hosts = members.join(blocks.withColumn("ball", F.col("home")), "ball")
    guests = sides.select("home", "ball").join(blocks, "home").join(members, "ball")
    rows = dealt(hosts, "down", "across", False).unionByName(dealt(guests, "across", "down", True))

    def product(held):
        import pyarrow as pa

        guest = held.column("guest").to_numpy(zero_copy_only=False)
        c, ball, size = (held.column(n).to_numpy() for n in ("c", "ball", "size"))
        u = _normed(_vectors(held.column("v"), width))
        near = u[~guest] @ u[guest].T >= threshold
        linked = np.flatnonzero(near.any(axis=0))
        home = ball[~guest][:1]
        down = near @ size[guest]
        across = size[~guest] @ near
        some = np.flatnonzero(down)
        # for the hosts the count, for the guests the group they link with as well
        return pa.table({
            "c": np.concatenate((c[~guest][some], c[guest][linked])),
            "others": np.concatenate((down[some], across[linked])),
            "ball": np.concatenate((ball[~guest][some], ball[guest][linked])),
            "other": np.concatenate((np.repeat(home, len(some)), np.repeat(home, len(linked)))),
        })

    return materialise(
        rows.groupBy("home", "i", "j").applyInArrow(product, "c long, others long, ball long, other long"),
        "vector-counts",
    )


def gathered_classes(numbered: DataFrame, threshold: float) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(classes with ball, angle and ``crowded``, written; (width, number of classes) to be compared)."""
    widths = [
        (r["n"], r["count"])
        for r in numbered.groupBy(F.size("v").alias("n")).count().where("count > 1").orderBy("n").collect()
    ]
    balls = numbered.select("c", F.col("c").alias("ball"), F.lit(0.0).alias("angle")).limit(0)
    for width, n in widths:
        balls = balls.unionByName(crowds(numbered.where(F.size("v") == width), n, width, threshold))
    crowded = F.col("ball").isNotNull()
    gathered = numbered.join(balls, "c", "left").select(
        "c", "class", "v", "size", "least", F.coalesce("ball", "c").alias("ball"),
        F.coalesce("angle", F.lit(0.0)).alias("angle"), crowded.alias("crowded"),
    )
    return materialise(gathered, "vector-gathered"), widths


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    held, numbered = classes(rows)
    gathered, widths = gathered_classes(numbered, threshold)
    found = gathered.select(F.col("c").alias("a"), F.col("c").alias("b")).limit(0)
    singly = gathered.select("c", F.col("size").alias("others"), "ball", F.col("ball").alias("other")).limit(0)
    for width, n in widths:
        here = gathered.where(F.size("v") == width)
        near = compared(here, candidates(here, n, width, threshold), width, threshold)
        found = found.unionByName(near.where("whole").select("a", "b"))
        singly = singly.unionByName(counted(here, near.where("NOT whole").select("a", "b"), width, threshold))
    balls = gathered.groupBy("ball").agg(F.sum("size").alias("weight"), F.min("least").alias("least"))
    ends = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = (
        ends.join(balls.select(F.col("ball").alias("b"), "weight"), "b")
        .groupBy("a").agg(F.sum("weight").alias("others")).withColumnRenamed("a", "ball")
    )
    bridges = singly.where("ball <> other").select(F.col("ball").alias("a"), F.col("other").alias("b"))
    parts = components(found.unionByName(bridges)).withColumnRenamed("node", "ball")
    known = (
        balls.join(linked, "ball", "left").join(parts, "ball", "left")
        .withColumn("component", F.coalesce("component", "ball"))
    )
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    group = known.join(least, "component").select(
        "ball", "component_id", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("by_group")
    )
    apart = singly.groupBy("c").agg(F.sum("others").alias("by_member"))
    told = gathered.select("c", "class", "ball").join(group, "ball").join(apart, "c", "left").select(
        "class", "component_id", (F.col("by_group") + F.coalesce("by_member", F.lit(0))).alias("n_links"),
    )
    component = F.coalesce("component_id", "vec_id")
    return held.select("vec_id", "class").join(told, "class", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def op1_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "embeddings"))
