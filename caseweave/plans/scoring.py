"""Score predicted activity lists against the true ones and aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.fixed import DELETE, INSERT, MEAN_METRICS
from caseweave.functions.sequences import confusion_labels, with_pair_metrics

# Blocks the columns of a dense matrix are dealt into.
LABEL_BLOCKS = 64
# A wide table has a column per activity; more of them are read as lines of text or in the long form.
MAX_COLUMNS = 20_000


def score(records: DataFrame) -> DataFrame:
    """One wide row per record that has an e-mail; placeholders are skipped.

    Expects ``record_pos, unit_id, case_id, has_email, true_members, pred,
    confidence, declared_size``. Row-local: no shuffle.
    """
    empty = F.array().cast("array<string>")
    real = records.where("has_email").select(
        "record_pos",
        F.coalesce("unit_id", F.lit("")).alias("unit_id"),
        F.coalesce("case_id", F.lit("")).alias("case_id"),
        "declared_size",
        F.coalesce("true_members", empty).alias("true"),
        F.coalesce("pred", empty).alias("pred"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )
    reserved = F.array(F.lit(INSERT), F.lit(DELETE))
    checked = real.withColumn(
        "true",
        F.when(
            F.arrays_overlap("true", reserved) | F.arrays_overlap("pred", reserved),
            F.raise_error(F.lit("an activity is named like a gap sentinel")),
        ).otherwise(F.col("true")),
    )
    size = F.coalesce(F.nullif("declared_size", F.lit(0)), F.size("true"))
    return (
        with_pair_metrics(checked, "true", "pred")
        .withColumn("size", size.cast("long"))
        .drop("declared_size")
    )


def run_counts(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count("*").alias("n_records"),
        F.count_if("has_email").alias("n_scored"),
    )


def _scope(grouping: Column) -> Column:
    """Which grouping set a row belongs to, from its grouping id."""
    return (
        F.when(grouping == 3, "overall").when(grouping == 1, "size").otherwise("unit")
    )


def summary(scored: DataFrame) -> DataFrame:
    """Mean and population deviation of every metric, overall, by size and by unit.

    One pass; values stay unrounded. ``first_size`` is the size of a unit's
    first record.
    """
    stats = [F.avg(m).alias(m) for m in MEAN_METRICS]
    stats += [F.stddev_pop(m).alias(f"{m}_std") for m in MEAN_METRICS]
    return (
        scored.groupingSets([[], ["size"], ["unit_id"]], "size", "unit_id")
        .agg(
            F.grouping_id().alias("_set"),
            F.count("*").alias("n"),
            F.avg(F.col("exact_match").cast("double")).alias("exact_rate"),
            F.min_by(scored["size"], scored["record_pos"]).alias("first_size"),
            *stats,
        )
        .withColumn("scope", _scope(F.col("_set")))
        .drop("_set")
    )


def category_mix(scored: DataFrame) -> DataFrame:
    """Count per category, overall, by size and by unit."""
    return (
        scored.groupingSets(
            [["category"], ["size", "category"], ["unit_id", "category"]],
            "size", "unit_id", "category",
        )
        .agg(F.grouping_id().alias("_set"), F.count("*").alias("n"))
        # the category bit is always 0, the other two match the summary's
        .withColumn("scope", _scope(F.shiftright("_set", 1)))
        .drop("_set")
    )


def confusion_cells(scored: DataFrame) -> DataFrame:
    """Aligned (true, pred) label counts per size; gaps carry the sentinels."""
    steps = scored.select("size", F.explode("alignment").alias("step"))
    return (
        steps.select("size", *confusion_labels(F.col("step")))
        .groupBy("size", "true_label", "pred_label")
        .agg(F.count("*").alias("n"))
    )


def overall_cells(cells: DataFrame) -> DataFrame:
    return cells.groupBy("true_label", "pred_label").agg(F.sum("n").alias("n"))


def _kind() -> Column:
    return (
        F.when(F.col("true_label") == INSERT, "ins")
        .when(F.col("pred_label") == DELETE, "del")
        .when(F.col("true_label") == F.col("pred_label"), "match")
        .otherwise("sub")
    )


def confusion_totals(cells: DataFrame, by: list[str]) -> DataFrame:
    """Match/sub/ins/del totals and their rates over aligned tokens."""
    kinds = ["match", "sub", "ins", "del"]
    totals = cells.groupBy(*by).agg(
        *[
            F.coalesce(F.sum(F.when(_kind() == k, F.col("n"))), F.lit(0)).alias(f"n_{k}")
            for k in kinds
        ],
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_aligned"),
    )
    return totals.withColumns({
        f"{k}_rate": F.coalesce(F.try_divide(f"n_{k}", "n_aligned"), F.lit(0.0)) for k in kinds
    })


def substitutions(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Off-diagonal pairs without gaps, most frequent first (in each group of *by*)."""
    return cells.where(_kind() == "sub").orderBy(*by, F.desc("n"), "true_label", "pred_label")


def confusion_label_list(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Activities seen on either side, sorted; the sentinels are not among them."""
    return (
        cells.select(*by, F.explode(F.array("true_label", "pred_label")).alias("label"))
        .where(~F.col("label").isin(INSERT, DELETE))
        .distinct()
        .orderBy(*by, "label")
    )


def dense_matrix(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Every label pair including both sentinels, zeros filled (long form).

    With *by*, one matrix per group, of the labels seen in it. Columns are dealt
    into blocks and each row label is sent to every block, so the grid is made
    by as many tasks as there are blocks.
    """
    sentinels = cells.groupBy(*by).agg(F.count("*").alias("_n")).select(
        *by, F.explode(F.array(F.lit(INSERT), F.lit(DELETE))).alias("label")
    )
    axis = confusion_label_list(cells, by).unionByName(sentinels)
    block = F.pmod(F.xxhash64("label"), F.lit(LABEL_BLOCKS)).cast("int")
    down = axis.select(
        *by, F.col("label").alias("true_label"),
        F.explode(F.sequence(F.lit(0), F.lit(LABEL_BLOCKS - 1))).alias("block"),
    )
    across = axis.select(*by, F.col("label").alias("pred_label"), block.alias("block"))
    grid = down.join(across, [*by, "block"]).drop("block")
    return grid.join(cells, [*by, "true_label", "pred_label"], "left").fillna(0, ["n"])


def sparse_matrix(dense: DataFrame) -> DataFrame:
    """Rows are activities plus insertions, columns activities plus deletions."""
    return dense.where(
        (F.col("true_label") != DELETE) & (F.col("pred_label") != INSERT)
    )


def matrix_table(cells: DataFrame) -> DataFrame:
    """The sparse matrix in wide form, one column per predicted label.

    More columns than a table can have come as lines of ``reports.matrix_lines``.
    """
    labels = [r.label for r in confusion_label_list(cells).limit(MAX_COLUMNS + 1).collect()]
    if len(labels) > MAX_COLUMNS:
        raise ValueError("too many columns for one table; use reports.matrix_lines")
    return (
        cells.groupBy("true_label")
        .pivot("pred_label", [*labels, DELETE])
        .agg(F.sum("n"))
        .fillna(0)
    )


def fp_fn(scored: DataFrame) -> DataFrame:
    """Surplus and missing tokens per record in long form."""
    def side(column: str, kind: str) -> DataFrame:
        return scored.select(
            "record_pos", F.lit(kind).alias("kind"), F.explode(column).alias("activity", "n")
        )

    return side("fp", "fp").unionByName(side("fn", "fn"))
