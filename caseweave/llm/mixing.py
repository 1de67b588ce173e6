"""Mixing sources to target weights, by blocks drawn per output shard.

Only DataFrame functions run here.

1. Each source's documents stand in a row, by id; their words are packed into
   blocks of ``BLOCK`` words, which run over document ends. A source's last
   block may be shorter.
2. Targets: every source weighs something and all sources share the total size
   by weight. No target is above ``MAX_EPOCHS`` times its source; what is cut
   off there is shared again by weight. With sources in the order in which they
   reach that ceiling this is one running sum.
3. The mix is a row of slots, ``SHARD`` of them to an output shard. Each slot
   draws a source with probability proportional to the sources' slots, which
   makes the counts of a shard multinomial. Over all shards such draws miss a
   source's slots by some root of them, and a source at its ceiling would run
   over it every other time; so the slots that a source has drawn beyond its
   own are handed, in shard order, to the sources that are short.
4. A source's k-th slot takes block ``p(k mod n)``, where n is its number of
   blocks and p the pseudorandom permutation that sorts its blocks by a hash;
   so each pass over the source is complete before the next begins, and no
   block is taken more than ``MAX_EPOCHS`` times.
5. Slots meet the documents' pieces by (source, block).

Defined cases: a null or blank text has size 0 and is never taken; a null
source is a source of its own, last in order; repeated rows are documents of
their own; an empty table gives an empty mix; sources without words get target
0. Taken words are within half a block and what the last block is short of
the target. Ids may be null; they only set the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseweave.llm.common import bind, load, materialise, running_total, words_of

BLOCK = 64
SHARD = 4096
MAX_EPOCHS = 3
SEED = 20_240_229


def cycled(n: Column) -> Column:
    """Weights 1, 2, 3, 1, 2, 3 ... by place in source order."""
    return ((n - 1) % 3 + 1).cast("long")


def sized(docs: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    """Row number, id, source, number of words and text hash of each document; written."""
    return materialise(
        docs.select(
            F.monotonically_increasing_id().alias("_row"),
            F.col(id_col).alias("_id"),
            F.col(source).alias("_source"),
            F.coalesce(F.size(words_of(F.col(text))), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(text).alias("_text"),
        ),
        "sized",
    )


def targets(rows: DataFrame, weight=cycled, block: int = BLOCK) -> DataFrame:
    """One row per source: number, size, weight, target, blocks, slots; written.

    The windows here hold one row per source, of which a mixture has few.
    """
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    sizes = (
        rows.groupBy("_source").agg(F.sum("size").alias("source_size"))
        .withColumn("_s", F.row_number().over(by_name).cast("long"))
        .withColumn("_w", weight(F.col("_s")))
    )
    everything = Window.partitionBy()
    full = Window.orderBy(F.col("source_size") / F.col("_w"), "_s").rowsBetween(
        Window.unboundedPreceding, -1
    )
    most = (MAX_EPOCHS * F.col("source_size")).cast("double")
    # what a unit of weight gets if exactly the sources before this one stand at their ceilings
    unit = (
        F.sum("source_size").over(everything)
        - MAX_EPOCHS * F.coalesce(F.sum("source_size").over(full), F.lit(0))
    ).cast("double") / (
        F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(full), F.lit(0))
    )
    first_below = F.min(F.when(most >= F.col("_unit") * F.col("_w"), F.struct("_place", "_unit")))
    blocks = F.ceil(F.col("source_size") / block)
    return materialise(
        sizes.withColumn("_unit", unit)
        .withColumn("_place", F.count("*").over(full))
        .withColumn("_unit", first_below.over(everything)["_unit"])
        .withColumn("target", F.least(most, F.col("_unit") * F.col("_w")))
        .withColumn("_blocks", blocks)
        .withColumn(
            "_slots",
            F.when(F.col("source_size") > 0, F.round(F.col("target") * blocks / F.col("source_size")))
            .otherwise(0).cast("long"),
        )
        .drop("_unit", "_place"),
        "targets",
    )


def _intervals(rows: DataFrame, order: list[str], length: str) -> DataFrame:
    """Adds ``_lo``, the sum of *length* over the rows before; few rows."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_lo", F.coalesce(F.sum(length).over(before), F.lit(0)))


def draw(sources: DataFrame, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(shard, source, first slot of the source, slots): what each output shard takes."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("_slots")).first()[0] or 0
    # Slots find their source by equal cells: a cell is a 1024th of the interval [0, total),
    # a source is listed in each cell that its share of the interval touches.
    cell = max(1, -(-total // 1024))
    listed = (
        _intervals(sources.where("_slots > 0"), ["_s"], "_slots")
        .withColumn("_hi", F.col("_lo") + F.col("_slots"))
        .withColumn(
            "_cell",
            F.explode(
                F.sequence(F.floor(F.col("_lo") / cell), F.floor((F.col("_hi") - 1) / cell))
            ),
        )
        .select("_s", "_lo", "_hi", "_cell")
    )
    drawn = (
        spark.range(total)
        .select(
            F.floor(F.col("id") / shard).alias("shard"),
            F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(total, 1))).alias("_u"),
        )
        .withColumn("_cell", F.floor(F.col("_u") / cell))
        .join(listed, "_cell")
        .where("_u >= _lo AND _u < _hi")
        .groupBy("shard", "_s").agg(F.count("*").alias("_n"))
    )
    ranked = running_total(drawn, ["_s"], ["shard"], F.col("_n"), "_before")
    own = F.least(F.col("_n"), F.greatest(F.col("_slots") - F.col("_before"), F.lit(0)))
    kept = materialise(
        ranked.join(sources.select("_s", "_slots"), "_s")
        .select("shard", "_s", own.alias("_n"), (F.col("_n") - own).alias("_over")),
        "drawn",
    )
    spare = running_total(
        kept.where("_over > 0").select("shard", "_s", "_over"), [], ["shard", "_s"],
        F.col("_over"), "_from",
    ).select(
        "shard", F.explode(F.expr("sequence(_from, _from + _over - 1)")).alias("_unit")
    )
    short = (
        sources.where("_slots > 0")
        .join(kept.groupBy("_s").agg(F.sum("_n").alias("_got")), "_s", "left")
        .withColumn("_short", F.col("_slots") - F.coalesce("_got", F.lit(0)))
        .where("_short > 0")
    )
    wanted = _intervals(short, ["_s"], "_short").select(
        "_s", F.explode(F.expr("sequence(_lo, _lo + _short - 1)")).alias("_unit")
    )
    handed = spare.join(wanted, "_unit").groupBy("shard", "_s").agg(F.count("*").alias("_n"))
    final = (
        kept.select("shard", "_s", "_n").unionByName(handed)
        .groupBy("shard", "_s").agg(F.sum("_n").alias("_n")).where("_n > 0")
    )
    return running_total(final, ["_s"], ["shard"], F.col("_n"), "_first")


def pieces(rows: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, source, block, first word in the document, words): documents cut at block ends."""
    coded = rows.where("size > 0").join(
        sources.select(F.col("_source").alias("_name"), "_s"),
        F.col("_source").eqNullSafe(F.col("_name")),
    ).select("_row", "_id", "_text", "_s", "size")
    placed = running_total(coded, ["_s"], ["_id", "_text"], F.col("size"), "_at")
    spans = placed.select(
        "_row", "_s", "size", "_at",
        F.explode(
            F.sequence(F.floor(F.col("_at") / block), F.floor((F.col("_at") + F.col("size") - 1) / block))
        ).alias("_block"),
    )
    start = F.greatest(F.col("_block") * block - F.col("_at"), F.lit(0))
    end = F.least((F.col("_block") + 1) * block - F.col("_at"), F.col("size"))
    return spans.select("_row", "_s", "_block", start.alias("_start"), (end - start).alias("_words"))


def permuted(sources: DataFrame, seed: int = SEED) -> DataFrame:
    """(source, block, place): each source's blocks in pseudorandom order."""
    blocks = sources.where("_blocks > 0").select(
        "_s", F.explode(F.expr("sequence(0L, _blocks - 1)")).alias("_block")
    ).withColumn("_key", F.xxhash64("_s", "_block", F.lit(seed)))
    return running_total(blocks, ["_s"], ["_key", "_block"], F.lit(1), "_place").drop("_key")


def mix(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(shard, source, slot, epoch, row, first word, words): the mix, slot by slot."""
    slots = (
        draw(sources)
        .select("shard", "_s", F.explode(F.expr("sequence(_first, _first + _n - 1)")).alias("_slot"))
        .join(sources.select("_s", "_blocks"), "_s")
        .select(
            "shard", "_s", "_slot", (F.col("_slot") % F.col("_blocks")).alias("_place"),
            F.floor(F.col("_slot") / F.col("_blocks")).alias("_epoch"),
        )
    )
    return (
        slots.join(permuted(sources), ["_s", "_place"])
        .join(pieces(rows, sources), ["_s", "_block"])
        .select("shard", "_s", "_slot", "_epoch", "_row", "_start", "_words")
    )


def taken_words(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: id, size, its source's size and target, and the words the mix takes."""
    rows = sized(docs, id_col, "text", "source")
    sources = targets(rows)
    taken = mix(rows, sources).groupBy("_row").agg(F.sum("_words").alias("taken"))
    return (
        rows.join(
            sources.select(F.col("_source").alias("_name"), "source_size", "target"),
            F.col("_source").eqNullSafe(F.col("_name")),
        )
        .join(taken, "_row", "left")
        .select(
            F.col("_id").alias(id_col), "size", "source_size", "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents, with the columns of *docs*.

    A document comes once for each pass in which any of its blocks is taken,
    with the words of those blocks: whole, its text as it is; else the taken
    words in order, joined by spaces. ``n_chars`` is counted anew.
    """
    held = materialise(
        docs.select(F.struct(*docs.columns).alias("_doc"), F.monotonically_increasing_id().alias("_row")),
        "to-mix",
    )
    rows = materialise(
        held.select(
            "_row", F.col("_doc.doc_id").alias("_id"), F.col("_doc.source").alias("_source"),
            F.coalesce(F.size(words_of(F.col("_doc.text"))), F.lit(0)).cast("long").alias("size"),
            F.xxhash64("_doc.text").alias("_text"),
        ),
        "sized",
    )
    passes = (
        mix(rows, targets(rows))
        .groupBy("_row", "_epoch")
        .agg(
            F.sum("_words").alias("_taken"),
            F.sort_array(F.collect_list(F.struct("_start", "_words"))).alias("_cuts"),
        )
        .join(rows.select("_row", "size"), "_row")
        .withColumn("_cuts", F.when(F.col("_taken") < F.col("size"), F.col("_cuts")))
        .groupBy("_row").agg(F.collect_list(F.struct("_epoch", "_cuts")).alias("_passes"))
    )

    def cut(w: Column, cuts: Column) -> Column:
        return F.array_join(
            F.flatten(
                F.transform(
                    cuts,
                    lambda c: F.slice(w, (c["_start"] + 1).cast("int"), c["_words"].cast("int")),
                )
            ),
            " ",
        )

    out = held.join(passes, "_row").select("_doc", F.explode("_passes").alias("_pass"))
    whole = F.col("_doc.text")
    given = {c: F.col("_doc")[c].alias(c) for c in docs.columns}
    given["text"] = F.when(F.col("_pass._cuts").isNull(), whole).otherwise(
        bind(words_of(whole), lambda w: cut(w, F.col("_pass._cuts")))
    ).alias("text")
    out = out.select(*given.values())
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def op6_multinomial_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(load(spark, sf_dir, "documents"))
