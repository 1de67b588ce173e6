"""Report tables: rounded summary values and formatted cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.fixed import DELETE, INSERT, MEAN_METRICS
from caseweave.plans import scoring

# --- fixed values: report columns and the metric each one shows ---------------------
REPORT_COLUMNS = {
    "ms_f1": "multiset_f1", "ms_prec": "multiset_precision", "ms_rec": "multiset_recall",
    "seq_f1": "seq_f1", "seq_prec": "seq_precision", "seq_rec": "seq_recall",
    "norm_edit": "normalized_edit_distance", "jaccard": "jaccard", "len_bias": "length_bias",
}


def _written(values: pa.Array, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """Values with so many decimals, correctly rounded from the binary value, and which are null."""
    missing = np.asarray(values.is_null())
    return np.char.mod(f"%.{digits}f", values.fill_null(0.0).to_numpy(zero_copy_only=False)), missing


@F.arrow_udf(T.DoubleType())
def _rounded(values: pa.Array) -> pa.Array:
    # twelve digits first: sums added in another order end in other noise, and a
    # tie must be a tie whichever way it was added
    text, missing = _written(values, 12)
    text, _ = _written(pa.array(text.astype(np.float64)), 4)
    return pa.array(text.astype(np.float64), mask=missing)


@F.arrow_udf(T.StringType())
def _fixed(values: pa.Array) -> pa.Array:
    text, missing = _written(values, 3)
    return pa.array(text.astype(object), pa.string(), mask=missing)


def exported(value: Column) -> Column:
    """Four decimals of the binary value, ties to even; Spark's rounding works on
    the decimal text and differs on ties. Used on aggregated rows only."""
    return _rounded(value)


def cell(mean: str, std: str | None = None) -> Column:
    """``mean ± std`` at three decimals of the exported values."""
    text = _fixed(exported(F.col(mean)))
    return text if std is None else F.concat_ws(" ± ", text, _fixed(exported(F.col(std))))


def summary_export(summary: DataFrame) -> DataFrame:
    """The summary in long form: (scope, size, unit_id, metric, value)."""
    metrics = [*MEAN_METRICS, *[f"{m}_std" for m in MEAN_METRICS], "exact_rate"]
    pairs = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("raw")) for m in metrics
    ])
    long = summary.select("scope", "size", "unit_id", "n", F.inline(pairs))
    return long.select("scope", "size", "unit_id", "n", "metric", exported(F.col("raw")).alias("value"))


def metric_table(summary: DataFrame) -> DataFrame:
    """Overall and by-size rows of the report."""
    return summary.where("scope <> 'unit'").select(
        "scope", "size", "n", cell("exact_rate").alias("exact"),
        *[cell(m, f"{m}_std").alias(name) for name, m in REPORT_COLUMNS.items()],
    )


def unit_table(summary: DataFrame) -> DataFrame:
    """By-unit rows of the report."""
    return summary.where("scope = 'unit'").select(
        F.col("unit_id").alias("unit"), F.col("first_size").alias("size"), "n",
        cell("exact_rate").alias("exact"),
        cell("multiset_f1", "multiset_f1_std").alias("multiset_f1"),
        cell("normalized_edit_distance", "normalized_edit_distance_std").alias("norm_edit"),
    )


def ops_table(totals: DataFrame) -> DataFrame:
    """``count (rate)`` per kind of alignment step, sizes without errors left out."""
    imperfect = totals.where("n_sub + n_ins + n_del > 0") if "size" in totals.columns else totals
    return imperfect.select(
        *[c for c in totals.columns if c == "size"], "n_aligned",
        *[
            F.concat(F.col(f"n_{k}"), F.lit(" ("), _fixed(F.col(f"{k}_rate")), F.lit(")")).alias(k)
            for k in ("match", "sub", "ins", "del")
        ],
    )


def ops_report(cells: DataFrame) -> DataFrame:
    """The overall row (without size) and a row per size that has errors."""
    by_size = ops_table(scoring.confusion_totals(cells, ["size"]))
    overall = ops_table(scoring.confusion_totals(cells, []))
    return by_size.unionByName(overall, allowMissingColumns=True)


def scored_lines(scored: DataFrame) -> DataFrame:
    """Scored rows as JSON lines with both lists and all differences: (record_pos, line)."""
    return scored.select("record_pos", F.to_json(F.struct(
        "unit_id", "size", "case_id", "true", "pred", "confidence", "category",
        "fp", "fn", "ops", "subs",
    )).alias("line"))


def _buckets(summary: DataFrame, categories: DataFrame) -> DataFrame:
    """(scope, size, unit_id, n, metrics.., categories) per bucket, values as exported."""
    mixes = categories.groupBy("scope", "size", "unit_id").agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("n")).alias("o"), "category", "n"))
        ).alias("mix")
    )
    same = [summary[c].eqNullSafe(mixes[c]) for c in ("scope", "size", "unit_id")]
    metrics = [*MEAN_METRICS, *[f"{m}_std" for m in MEAN_METRICS], "exact_rate"]
    return summary.join(mixes, same).select(
        summary["scope"], summary["size"], summary["unit_id"], "first_size", "n",
        *[exported(F.col(m)).alias(m) for m in metrics],
        F.map_from_entries(F.transform("mix", lambda x: F.struct(x["category"], x["n"])))
        .alias("categories"),
    )


def summary_json(
    counts: DataFrame, summary: DataFrame, categories: DataFrame, totals: DataFrame
) -> DataFrame:
    """The summary as JSON lines, one object per bucket: (scope, line).

    :func:`summary_document` has all of it in one document.
    """
    buckets = _buckets(summary, categories).drop("first_size")
    as_line = F.to_json(F.struct(*[c for c in buckets.columns if c != "scope"]))
    lines = buckets.select("scope", as_line.alias("line"))
    for scope, table in (("config", counts), ("confusion", totals)):
        lines = lines.unionByName(
            table.select(F.lit(scope).alias("scope"), F.to_json(F.struct("*")).alias("line"))
        )
    return lines


# --- the summary as one document ------------------------------------------------------

_ORDER = ["part", "size", "step", "rank", "first", "second"]


def _fragments(df: DataFrame, text: Column, **order: Column) -> DataFrame:
    kinds = dict.fromkeys(_ORDER, "long") | {"first": "string", "second": "string"}
    return df.select(
        *[F.lit(order.get(c)).cast(kind).alias(c) if not isinstance(order.get(c), Column)
          else order[c].cast(kind).alias(c) for c, kind in kinds.items()],
        text.alias("text"),
    )


def _listed(items: DataFrame) -> DataFrame:
    """Fragments of lists with a comma before all but the first of each list."""
    lists, place = ["part", "size", "step"], ["rank", "first", "second"]
    heads = items.groupBy(*lists).agg(F.min(F.struct(*place)).alias("_head")).select(
        *[F.col(c).alias(f"_{c}") for c in lists], "_head"
    )
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in lists]
    is_head = F.struct(*place).eqNullSafe(F.col("_head"))
    return items.join(heads, on).select(
        *_ORDER, F.when(is_head, F.col("text")).otherwise(F.concat(F.lit(","), "text")).alias("text")
    )


def _quoted(value: Column) -> Column:
    """*value* as a JSON string."""
    return F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1)


def _label_rank(label: Column) -> Column:
    return F.when(label == INSERT, 1).when(label == DELETE, 2).otherwise(0)


def _field(label: Column) -> Column:
    """A label as a field of comma-separated values."""
    quoted = F.concat(F.lit('"'), F.replace(label, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(label.rlike('[",\r\n]'), quoted).otherwise(label)


def matrix_lines(cells: DataFrame) -> DataFrame:
    """(place, first, line): the sparse matrix as comma-separated lines, for any number of labels.

    The head line comes first by (place, first), then activities in order, insertions last;
    deletions are the last column. A line is one value, and no other value grows with the labels.
    """
    rows = scoring.sparse_matrix(scoring.dense_matrix(cells)).groupBy("true_label").agg(F.array_sort(
        F.collect_list(F.struct(_label_rank(F.col("pred_label")).alias("r"), "pred_label", "n"))
    ).alias("row"))
    # every row names all columns: those of the insertions, which are always there, make the head line
    head = rows.where(F.col("true_label") == INSERT).select(
        F.lit(-1).alias("place"), F.lit("").alias("first"),
        F.concat(F.lit("true_label,"), F.array_join(
            F.transform("row", lambda x: _field(x["pred_label"])), ","
        )).alias("line"),
    )
    counts = F.array_join(F.transform("row", lambda x: x["n"].cast("string")), ",")
    return head.unionByName(rows.select(
        _label_rank(F.col("true_label")).cast("int").alias("place"), F.col("true_label").alias("first"),
        F.concat(_field(F.col("true_label")), F.lit(","), counts).alias("line"),
    ))


def _confusion_fragments(cells: DataFrame, part: int, by: tuple[str, ...]) -> DataFrame:
    """One confusion report, or one per size: labels, matrix, totals, substitutions."""
    size = F.col("size") if by else F.lit(None)
    dense = scoring.dense_matrix(cells, by)
    labels = dense.select(*by, F.col("true_label").alias("label")).distinct()
    row = dense.groupBy(*by, "true_label").agg(F.array_sort(F.collect_list(
        F.struct(_label_rank(F.col("pred_label")).alias("r"), "pred_label", "n")
    )).alias("row"))
    totals = scoring.confusion_totals(cells, list(by))
    counts = F.concat(*[
        x for name in ("n_aligned", "n_match", "n_sub", "n_ins", "n_del")
        for x in (F.lit(f'"{name}":'), F.col(name), F.lit(","))
    ])
    fixed = F.array(*[
        F.struct(F.lit(step).alias("step"), text.alias("text")) for step, text in (
            (1, F.lit('"labels":[')), (3, F.lit('],"matrix":[')),
            (5, F.concat(F.lit("],"), counts, F.lit('"substitutions":['))), (7, F.lit("]")),
        )
    ])
    subs = scoring.substitutions(cells, by)
    return (
        _fragments(totals.select(*by, F.inline(fixed)), F.col("text"), part=part, size=size, step=F.col("step"))
        .unionByName(_listed(_fragments(
            labels, _quoted(F.col("label")), part=part, size=size, step=2,
            rank=_label_rank(F.col("label")), first=F.col("label"),
        )))
        .unionByName(_listed(_fragments(
            row, F.concat(F.lit("["), F.array_join(F.transform("row", lambda x: x["n"]), ","), F.lit("]")),
            part=part, size=size, step=4, rank=_label_rank(F.col("true_label")), first=F.col("true_label"),
        )))
        .unionByName(_listed(_fragments(
            subs, F.concat(
                F.lit("["), _quoted(F.col("true_label")), F.lit(","), _quoted(F.col("pred_label")),
                F.lit(","), F.col("n"), F.lit("]"),
            ),
            part=part, size=size, step=6, rank=-F.col("n"), first=F.col("true_label"),
            second=F.col("pred_label"),
        )))
    )


def summary_document(
    counts: DataFrame, summary: DataFrame, categories: DataFrame, cells: DataFrame
) -> DataFrame:
    """The whole summary as one JSON document in parts: order columns and ``text``.

    Sections are config, overall, by_size, by_unit and confusion, which has the
    overall report and one per size. Parts in the order of ``_ORDER`` make the
    document; a unit, a label, a row of a matrix is a part, so nothing has to hold
    more than that. *cells* are those of :func:`scoring.confusion_cells`.
    """
    spark = summary.sparkSession
    buckets = _buckets(summary, categories)
    shown = [c for c in buckets.columns if c not in ("scope", "size", "unit_id", "first_size")]
    body = F.to_json(F.struct(*shown))
    of_unit = F.to_json(F.struct(F.col("first_size").alias("size"), *shown))

    def scope(name: str) -> DataFrame:
        return buckets.where(F.col("scope") == name)

    frame = spark.createDataFrame(
        [(2, ',"by_size":{'), (4, '},"by_unit":{'), (6, '},"confusion":{'), (8, ',"by_size":{'), (10, "}}}")],
        "part long, text string",
    )
    sizes = cells.select("size").distinct()
    opened = _listed(_fragments(
        sizes, F.concat(F.lit('"'), F.col("size"), F.lit('":{')), part=9, rank=F.col("size"), step=0
    )).withColumn("size", F.col("rank")).withColumn("rank", F.lit(None).cast("long"))
    pieces = [
        _fragments(counts, F.concat(F.lit('{"config":'), F.to_json(F.struct(*counts.columns))), part=0),
        _fragments(scope("overall"), F.concat(F.lit(',"overall":'), body), part=1),
        _fragments(frame, F.col("text"), part=F.col("part")),
        _listed(_fragments(
            scope("size"), F.concat(F.lit('"'), F.col("size"), F.lit('":'), body), part=3, rank=F.col("size")
        )),
        _listed(_fragments(
            scope("unit"), F.concat(_quoted(F.col("unit_id")), F.lit(":"), of_unit), part=5,
            first=F.col("unit_id"),
        )),
        _confusion_fragments(scoring.overall_cells(cells), 7, ()),
        opened,
        _confusion_fragments(cells, 9, ("size",)),
        _fragments(sizes, F.lit("}"), part=9, size=F.col("size"), step=8),
    ]
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece)
    return out


def write_document(fragments: DataFrame, path: str) -> None:
    """The parts as text files whose lines, in the order of the files, are the document."""
    fragments.orderBy(*[F.asc_nulls_first(c) for c in _ORDER]).select("text").write.text(path)
