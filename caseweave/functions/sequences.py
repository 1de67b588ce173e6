"""Per-pair sequence metrics as columns over two token arrays.

Distance, LCS and alignment come from one pass of :mod:`alignment`, token counts
and rank agreement from another; everything else is built-in array expressions
over the token counts, each in one run over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.fixed import DELETE, INSERT
from caseweave.functions.alignment import align, tally


def _ratio(num: Column, den: Column) -> Column:
    return num.cast("double") / den.cast("double")


def _f1(precision: Column, recall: Column) -> Column:
    total = precision + recall
    return F.when(total == 0, F.lit(0.0)).otherwise(2 * precision * recall / total)


def _total(counts: Column, value) -> Column:
    return F.aggregate(counts, F.lit(0), lambda acc, c: acc + value(c))


def kendall_tau(n_shared: Column, n_discordant: Column) -> Column:
    """Rank agreement of first positions of shared tokens; 1.0 below two shared."""
    n = n_shared.cast("double")
    n_pairs = n * (n - 1) / 2
    return F.when(n < 2, F.lit(1.0)).otherwise((n_pairs - 2 * n_discordant) / n_pairs)


def category(true: Column, pred: Column, counts: Column) -> Column:
    """Kind of discrepancy, first matching rule wins."""
    only_true = F.exists(counts, lambda c: c["n_pred"] == 0)
    only_pred = F.exists(counts, lambda c: c["n_true"] == 0)
    unequal = F.exists(counts, lambda c: c["n_true"] != c["n_pred"])
    return (
        F.when(true == pred, "exact")
        .when(~unequal, "ordering")
        .when(
            ~only_true & ~only_pred,
            F.when(F.size(pred) > F.size(true), "multiplicity(over)").otherwise(
                "multiplicity(under)"
            ),
        )
        .when(only_pred & ~only_true, "over-generation")
        .when(only_true & ~only_pred, "under-generation")
        .otherwise("substitution/mixed")
    )


def _surplus(counts: Column, more: str, less: str) -> Column:
    extra = F.filter(counts, lambda c: c[more] > c[less])
    return F.map_from_arrays(
        F.transform(extra, lambda c: c["token"]),
        F.transform(extra, lambda c: c[more] - c[less]),
    )


def with_pair_metrics(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Add every per-pair metric, the error category, fp/fn maps and the alignment."""
    t, p = F.col(true), F.col(pred)
    df = df.withColumn("_aligned", align(t, p)).withColumn("_tally", tally(t, p))
    counts = F.col("_tally.counts")
    n, m = F.size(t), F.size(p)
    longest = F.greatest(n, m)
    both_empty = longest == 0
    overlap = _total(counts, lambda c: F.least(c["n_true"], c["n_pred"]))
    shared = F.size(F.filter(counts, lambda c: (c["n_true"] > 0) & (c["n_pred"] > 0)))
    n_types = F.size(F.filter(counts, lambda c: c["n_true"] > 0))
    m_types = F.size(F.filter(counts, lambda c: c["n_pred"] > 0))
    dot = _total(counts, lambda c: c["n_true"] * c["n_pred"])
    norms = F.sqrt(_total(counts, lambda c: c["n_true"] * c["n_true"])) * F.sqrt(
        _total(counts, lambda c: c["n_pred"] * c["n_pred"])
    )
    distance, lcs = F.col("_aligned.edit_distance"), F.col("_aligned.lcs_length")

    def share(hits: Column, size: Column, other: Column) -> Column:
        alone = F.when(other == 0, F.lit(1.0)).otherwise(F.lit(0.0))
        return F.when(size == 0, alone).otherwise(_ratio(hits, size))

    df = df.withColumns({
        "true_length": n,
        "pred_length": m,
        "length_bias": m - n,
        "edit_distance": distance,
        "lcs_length": lcs,
        "normalized_edit_distance": _ratio(distance, F.greatest(longest, F.lit(1))),
        "multiset_precision": share(overlap, m, n),
        "multiset_recall": share(overlap, n, m),
        "seq_precision": share(lcs, m, n),
        "seq_recall": share(lcs, n, m),
        "jaccard": F.when(both_empty, F.lit(1.0)).otherwise(_ratio(shared, F.size(counts))),
        "dice": F.when(both_empty, F.lit(1.0)).otherwise(
            _ratio(2 * shared, n_types + m_types)
        ),
        "cosine": F.when(both_empty, F.lit(1.0))
        .when((n == 0) | (m == 0), F.lit(0.0))
        .otherwise(dot / norms),
        "lcs_ratio": F.when(both_empty, F.lit(1.0)).otherwise(_ratio(lcs, longest)),
        "kendall_tau": kendall_tau(F.col("_tally.n_shared"), F.col("_tally.n_discordant")),
        "exact_match": t == p,
        "category": category(t, p, counts),
        "fp": _surplus(counts, "n_pred", "n_true"),
        "fn": _surplus(counts, "n_true", "n_pred"),
        "alignment": F.zip_with(
            F.col("_aligned.true_at"),
            F.col("_aligned.pred_at"),
            lambda i, j: F.struct(
                F.when(i > 0, F.try_element_at(t, i)).alias("true"),
                F.when(j > 0, F.try_element_at(p, j)).alias("pred"),
            ),
        ),
    })
    steps = F.col("alignment")

    def steps_where(rule) -> Column:
        return F.size(F.filter(steps, rule))

    return df.withColumns({
        "multiset_f1": _f1(F.col("multiset_precision"), F.col("multiset_recall")),
        "seq_f1": _f1(F.col("seq_precision"), F.col("seq_recall")),
        "ops": F.struct(
            steps_where(lambda s: s["true"] == s["pred"]).alias("match"),
            steps_where(lambda s: s["true"] != s["pred"]).alias("sub"),
            steps_where(lambda s: s["true"].isNull()).alias("ins"),
            steps_where(lambda s: s["pred"].isNull()).alias("del"),
        ),
        "subs": F.filter(steps, lambda s: s["true"] != s["pred"]),
    }).drop("_aligned", "_tally")


def confusion_labels(step: Column) -> tuple[Column, Column]:
    """Row and column label of one alignment step, with the gap sentinels."""
    return (
        F.coalesce(step["true"], F.lit(INSERT)).alias("true_label"),
        F.coalesce(step["pred"], F.lit(DELETE)).alias("pred_label"),
    )
