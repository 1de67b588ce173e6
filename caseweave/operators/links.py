"""A case graph laid out for walks: numbered nodes, and links bucketed by where they start.

Walks and rendering join on nodes again and again, so node ids become longs
once. The links of all nodes, both ways, are a table bucketed by start node; a
hop then moves its frontier to the links and never the links. No walk leaves an
actor that is no case, so links that start at one are not in it.

A node with very many links would fill one bucket. Its links are dealt over
several salts, at most ``limit`` links to each, and a frontier row that stands
on such a node goes to all of them. Every link says how many salts the node at
its end has, so a hop writes its rows for the next one without a look-up.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.fixed import CLUSTER, EVIDENCE, LABEL_RANK, OTHER_RANK
from caseweave.operators.graph import node_table
from caseweave.runtime import CODEC, compiled_methods, forget_table, materialise, written_path

#: Links of one node that stay in one bucket.
HOT_LINKS = 100_000
#: What a walk asks about the node at either end of a link, as bits.
FLAGS = {
    name: 1 << i for i, name in enumerate((
        "is_app", "is_case", "is_cluster", "is_actor", "is_leaky", "is_boundary", "links_case",
        "shown_as_cluster", "is_ranked", "is_anchor",
    ))
}
#: Low bits of a node's number that hold its flags, and those above that hold the rank of its
#: label; the rest is the running number of its row.
FLAG_BITS, RANK_BITS = len(FLAGS), OTHER_RANK.bit_length()
#: Counters per graph among which the links of all nodes are dealt to find those with very many.
COUNTERS = 65_536


def has(node: str, name: str) -> Column:
    """Whether the node of that number has a flag."""
    return F.col(node).bitwiseAND(F.lit(FLAGS[name]).cast("long")) != 0


def rank_of(node: str) -> Column:
    """Place of its label among those of rendered nodes."""
    return F.shiftright(node, FLAG_BITS).bitwiseAND(F.lit((1 << RANK_BITS) - 1).cast("long")).cast("int")


def _rank() -> Column:
    ranks = [F.when(F.col("label") == name, rank) for name, rank in LABEL_RANK.items()]
    return F.coalesce(*ranks, F.lit(OTHER_RANK))


def _flags() -> Column:
    values = {name: F.col(name) for name in FLAGS} | {
        "is_app": F.col("app_id").isNotNull(), "shown_as_cluster": F.col("label") == CLUSTER,
        "is_anchor": F.array_contains("labels", EVIDENCE),
    }
    total = F.lit(0)
    for name, bit in FLAGS.items():
        total = total + F.when(values[name], bit).otherwise(0)
    return total


class WalkGraph:
    """Tables of a graph, each written once; :meth:`drop` deletes them.

    ``nodes`` is the node table with a number (``node``), ``edges`` has (src,
    rel, dst) as numbers, ``apps`` the application ids with a code (``app``)
    that sorts as they do, ``links`` is the bucketed table, written when it is
    first asked for. *extra* adds columns to the nodes before they are written;
    without *keep_props* only those of applications keep their properties, by
    which ids are looked up. Edges whose ends are no nodes go. With *order*, numbers
    of nodes with the same label rank and flags sort as these columns of the node table.
    """

    def __init__(
        self, raw_nodes: DataFrame, edges: DataFrame, extra=None, hot_links: int = HOT_LINKS,
        keep_props: bool = True, order: list[Column] | None = None,
    ):
        self.spark = raw_nodes.sparkSession
        self.hot_links = hot_links
        number = F.shiftleft(F.monotonically_increasing_id(), FLAG_BITS + RANK_BITS).bitwiseOR(
            (F.shiftleft(_rank(), FLAG_BITS) + _flags()).cast("long")
        )
        numbered = node_table(raw_nodes)
        if order:
            numbered = numbered.repartitionByRange(*order).sortWithinPartitions(*order)
        numbered = numbered.withColumn("node", number)
        if extra:
            numbered = extra(numbered)
        if not keep_props:
            numbered = numbered.withColumn("props", F.when(F.col("app_id").isNotNull(), F.col("props")))
        self.nodes = materialise(numbered, "nodes")
        end = self.nodes.select("node_id", "node")
        ends = [
            end.select(F.col("node_id").alias(side), F.col("node").alias(f"{side}_node"))
            for side in ("src", "dst")
        ]
        self.edges = materialise(
            edges.join(ends[0], "src").join(ends[1], "dst").select(
                F.col("src_node").alias("src"), "rel", F.col("dst_node").alias("dst"),
            ),
            "edges",
        )
        self._hot = self._table = self._apps = None

    @property
    def hot(self) -> DataFrame | None:
        """(node, salts) of the nodes with more links than one bucket should hold, few by the
        limit; None without any."""
        if self._hot is None:
            self._hot = (self._find_hot(),)
        return self._hot[0]

    def _find_hot(self) -> DataFrame | None:
        """Links are counted for all nodes of a counter at once first, by the pass that counts the
        edges. The mean counter is below a sixth of the limit, so few nodes are left to be counted
        one by one."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("node")).withColumn(
            "counter", F.pmod(F.xxhash64("node"), F.lit(COUNTERS)).cast("int")
        )
        counted = ends.groupBy("counter").agg(F.count("*").alias("links"))
        largest, total = counted.agg(F.max("links"), F.sum("links")).first()
        limit = max(self.hot_links, (total or 0) // 2 // 5_000)
        if (largest or 0) <= limit:
            return None
        enough = F.col("links") > limit
        full = materialise(counted.where(enough).select("counter"), "counters")
        hot = materialise(
            ends.join(F.broadcast(full), "counter", "left_semi")
            .groupBy("node").agg(F.count("*").alias("links")).where(enough)
            .select("node", F.ceil(F.col("links") / limit).cast("int").alias("salts")),
            "hot",
        )
        return None if hot.isEmpty() else hot

    def salted(self, df: DataFrame, node: str, salts: str) -> DataFrame:
        """*df* with the number of salts of *node*."""
        if self.hot is None:
            return df.withColumn(salts, F.lit(1))
        # at most 10,000 rows: two ends of all edges hold that many times the limit
        hot = F.broadcast(self.hot.select(F.col("node").alias("_hot"), F.col("salts").alias("_salts")))
        return df.join(hot, F.col(node) == F.col("_hot"), "left").withColumn(
            salts, F.coalesce("_salts", F.lit(1))
        ).drop("_hot", "_salts")

    def _write_links(self) -> str:
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        pairs = self.edges.select(F.inline(F.array(
            F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
        ))).where(~has("src", "is_actor") | has("src", "is_app") | has("src", "is_case"))
        dealt = self.salted(self.salted(pairs, "src", "_n"), "dst", "dst_salts").withColumn(
            "salt", F.pmod(F.xxhash64("dst"), F.col("_n")).cast("int")
        ).drop("_n")
        name, path = f"links_{uuid.uuid4().hex}", written_path(self.spark, "links")
        with compiled_methods(self.spark):
            (
                # parallel edges collapse: a walk only asks whether two nodes touch
                dealt.repartition(self.buckets, "src", "salt").distinct()
                .write.bucketBy(self.buckets, "src", "salt").sortBy("src").option("path", path)
                .option("compression", CODEC)
                .saveAsTable(name)
            )
        return name

    @property
    def table(self) -> str:
        if self._table is None:
            self._table = self._write_links()
        return self._table

    @property
    def links(self) -> DataFrame:
        return self.spark.table(self.table)

    @property
    def apps(self) -> DataFrame:
        """(app_id, app): codes in the order of the ids, from a sort over range partitions."""
        if self._apps is None:
            ids = self.nodes.where("app_id is not null").select("app_id").distinct()
            self._apps = materialise(
                ids.repartitionByRange("app_id").sortWithinPartitions("app_id")
                .withColumn("app", F.monotonically_increasing_id()),
                "apps",
            )
        return self._apps

    def spread(self, df: DataFrame, node: str, salts: str) -> DataFrame:
        """Rows standing on *node*, one per salt of it, dealt like the links."""
        return (
            df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col(salts) - 1)))
            .repartition(self.buckets, node, "salt")
        )

    def case_numbers(self, df: DataFrame) -> DataFrame:
        """:meth:`numbers` of applications only, whose ids are a small part of all."""
        cases = self.nodes.where("app_id is not null").select("node_id", "node")
        return df.join(cases, "node_id").drop("node_id")

    def numbers(self, df: DataFrame) -> DataFrame:
        """*df* with ``node`` in place of ``node_id``."""
        return df.join(self.nodes.select("node_id", "node"), "node_id").drop("node_id")

    def names(self, df: DataFrame) -> DataFrame:
        """*df* with ``node_id`` in place of ``node``."""
        return df.join(self.nodes.select("node_id", "node"), "node").drop("node")

    def drop(self) -> None:
        """Delete the link table; the others go with the work area they were written in."""
        if self._table is not None:
            forget_table(self.spark, self._table)


#: Actors whose numbers go to every task, so that links that start at them never move.
MOST_ACTORS = 1_000_000


class IdGraph(WalkGraph):
    """A graph for walks that end in names: a node's number is the 64-bit hash of its id.

    Links get both numbers where they are read, so they move once each way round, to where they
    start, and no id moves with them. Up to two hops nothing is written: the steps share the shuffles
    of links and nodes. What a walk asks about a node is known at the node, where its rows arrive.

    Node rows of one id are one node with the labels of all, named as often as it has rows. Two ids
    of one hash end the job with an error, another *seed* helps. An end that is no node is not
    compared by its id; that it has the hash of a node by chance is not noticed.
    """

    def __init__(self, raw_nodes: DataFrame, edges: DataFrame, hot_links: int = HOT_LINKS, seed: int = 0):
        self.spark, self.hot_links, self.seed = raw_nodes.sparkSession, hot_links, seed
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.nodes = node_table(raw_nodes).where("node_id is not null").select(
            "node_id", self._hash("node_id").alias("node"), "label", "stable_id", "app_id", "pos",
            F.when(F.col("app_id").isNotNull(), F.col("props")).alias("props"),
            _flags().cast("long").alias("flags"),
        )
        self.edges = edges.where("src is not null and dst is not null").select(
            self._hash("src").alias("src"), "rel", self._hash("dst").alias("dst")
        )
        self._hot = self._table = self._apps = self._links = None

    def _hash(self, name: str) -> Column:
        return F.xxhash64(F.col(name), F.lit(self.seed))

    def _deal(self, df: DataFrame, *by: str) -> DataFrame:
        """Rows standing on ``node`` moved to it; to one of the salts of a hot node, by other columns."""
        dealt = df if self.hot is None else self._salted(df, *by)
        return dealt.repartition(self.buckets, *self._place)

    def _salted(self, df: DataFrame, *by: str) -> DataFrame:
        salt = F.pmod(F.xxhash64(*by), "_n").cast("int")
        return self.salted(df, "node", "_n").withColumn("salt", salt).drop("_n")

    def _everywhere(self, df: DataFrame) -> DataFrame:
        """Rows on all salts of their node; these are there already where no node is hot."""
        if self.hot is None:
            return df
        return self.spread(self.salted(df.drop("salt"), "node", "_n"), "node", "_n").drop("_n")

    @property
    def _place(self) -> list[str]:
        return ["node"] if self.hot is None else ["node", "salt"]

    @property
    def links(self) -> DataFrame:
        """(node, ends): neighbours, dealt over the salts of hot nodes. Parallel edges collapse, and
        links that are read together move together. An actor is not left, so its links stay away."""
        if self._links is None:
            actors = self.flagged("is_actor").where("app_id is null").where(~has("flags", "is_case"))
            pairs = self.edges.select(F.inline(F.array(
                F.struct(F.col("src").alias("node"), "dst"), F.struct(F.col("dst").alias("node"), F.col("src").alias("dst")),
            )))
            if actors.limit(MOST_ACTORS + 1).count() <= MOST_ACTORS:
                pairs = pairs.join(F.broadcast(actors.select("node")), "node", "left_anti")
            if self.hot is not None:
                pairs = self._salted(pairs, "dst")
            self._links = pairs.groupBy(*self._place).agg(F.collect_set("dst").alias("ends"))
        return self._links

    @property
    def named(self) -> DataFrame:
        """(node, node_id, flags, rows) at the nodes, on all salts of hot ones."""
        if self.hot is None:
            # the hash is computed again where the id arrives
            moved = self.nodes.select("node_id", "flags").repartition(self.buckets, self._hash("node_id"))
            moved = moved.withColumn("node", self._hash("node_id"))
        else:
            moved = self._everywhere(self.nodes.select("node_id", "flags", "node"))
        one = F.struct("node_id", "flags")
        ends = moved.groupBy(*self._place).agg(
            F.min(one).alias("a"), F.max(one).alias("b"), F.count("*").cast("int").alias("rows")
        )
        alike = F.col("a.node_id") == F.col("b.node_id")
        clash = F.raise_error(F.lit("two node ids of one hash: take another seed"))
        return ends.select(
            *self._place, F.when(alike, F.col("a.node_id")).otherwise(clash.cast("string")).alias("node_id"),
            F.when(alike, F.col("a.flags").bitwiseOR(F.col("b.flags"))).otherwise(clash.cast("long")).alias("flags"),
            "rows",
        )

    def flagged(self, name: str) -> DataFrame:
        return self.nodes.where(has("flags", name))

    def _those(self, df: DataFrame, name: str, how: str) -> DataFrame:
        """Rows standing on nodes with a flag (left_semi) or without (left_anti)."""
        some = self._everywhere(self.flagged(name).select("node"))
        return df.join(some, self._place, how)

    def case_seeds(self, resolved: DataFrame, key: str) -> DataFrame:
        starts = self._deal(resolved.select(key, "node"), key).distinct()
        near = self._step(self._everywhere(starts), self.links, key)
        return starts.unionByName(self._those(near, "is_cluster", "left_semi")).distinct()

    def _step(self, frontier: DataFrame, links: DataFrame, key: str) -> DataFrame:
        """Each (key, node) one link further, at the node."""
        met = frontier.join(links, self._place).select(key, F.explode("ends").alias("node"))
        return self._deal(met, key).distinct()

    def neighbourhood(self, seeds: DataFrame, hops: int, key: str, keep_leaky: bool) -> DataFrame:
        if self.hot is not None and "salt" not in seeds.columns:
            seeds = self._deal(seeds, key)
        starts = self._those(seeds.select(key, *self._place).distinct(), "is_actor", "left_anti")
        reached, frontier, links = starts, self._everywhere(starts), self.links
        for step in range(1, max(0, hops) + 1):
            level = self._step(frontier, links, key)
            if 1 < step < hops:
                # a longer walk would be planned over and over, level in level
                level = materialise(level, "level")
            reached = reached.unionByName(level.select(*reached.columns))
            if step < hops:
                on = level.join(self.named.select(*self._place, "flags"), self._place)
                on = on.where(~has("flags", "is_boundary"))
                if not keep_leaky:
                    on = on.where(~has("flags", "is_leaky"))
                frontier = self._everywhere(on.select(key, *self._place))
                # from now on nodes were come to: a node's only neighbour has been in the set before it
                links = self.links.where(F.size("ends") > 1) if self.hot is None else self.links
        reached = reached.distinct()
        if not keep_leaky:
            reached = self._those(reached, "is_leaky", "left_anti")
        return reached.select(key, "node")

    def case_numbers(self, df: DataFrame) -> DataFrame:
        return self.numbers(df)

    def numbers(self, df: DataFrame) -> DataFrame:
        return df.where("node_id is not null").withColumn("node", self._hash("node_id")).drop("node_id")

    def named_members(self, df: DataFrame) -> DataFrame:
        """*df* with ``node_id`` besides ``node``, a row for each row of the node."""
        at = df if self.hot is None else self._deal(df, *[c for c in df.columns if c != "node"])
        # few nodes have several rows
        once = F.when(F.col("rows") == 1, F.array("node_id")).otherwise(F.array_repeat("node_id", F.col("rows")))
        return at.join(self.named, self._place).select(*df.columns, F.explode(once).alias("node_id"))

    def names(self, df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c != "node"]
        # ids that sort together take less when they are written
        return self.named_members(df).select(*kept, "node_id").sortWithinPartitions("node_id")
