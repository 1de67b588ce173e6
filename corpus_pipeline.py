"""A corpus from documents: rules, near copies, repeated strings, mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again for the next. All but the last return the columns of the
documents; other columns of the input are carried along.

* ``quality_rules``: documents that fail the base rules or are depleted go; of
  the others the lines over the limit go.
* ``near_copies``: of each group of documents connected by 5-word Jaccard
  similarity of 0.8 or more the one with the least id stays.
* ``repeated_strings``: strings of 200 bytes that come more than once go.
* ``mixed_sources``: documents as often as the mix takes them, with the words it takes.
* ``packed``: the pieces of all documents with their sequences and offsets.

A stage begins by deleting the intermediate tables of the stages before it, whose
results have been written by then; what its own input reads stays.

Null texts fail the rules. Rows may repeat; the second stage keeps one of them.
Stages take empty tables and give empty ones.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm import line_quality, mixing, ngram_join, packing, suffixes
from caseweave.llm.common import load, materialise, release, written
from caseweave.llm.tokens import default_vocabulary


#: Words that a worker of the last stage remembers; the workers of all stages share the memory.
PACKED_WORDS = 80_000

#: Tables that earlier stages wrote on their way, by application.
_LEFT: dict[str, list[str]] = {}


def _clean(docs: DataFrame) -> None:
    app = docs.sparkSession.sparkContext.applicationId
    _LEFT[app] = release(docs, _LEFT.get(app, []))


def _keeping(spark: SparkSession, made: Callable[[], DataFrame]) -> DataFrame:
    before = set(written(spark))
    out = made()
    left = _LEFT.setdefault(spark.sparkContext.applicationId, [])
    left += [path for path in written(spark) if path not in before]
    return out


def _stage(work: Callable) -> Callable:
    @wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _clean(docs)
        return _keeping(spark, lambda: work(spark, docs, sf_dir))

    return stage


def _packed(docs: DataFrame) -> Column:
    """All columns of *docs* as one, so that no name of theirs can clash with a working column."""
    return F.struct(*docs.columns).alias("doc")


def _unpacked(rows: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of *docs* from column ``doc``, with another text."""
    given = {c: F.col("doc")[c].alias(c) for c in docs.columns}
    given["text"] = text.alias("text")
    if "n_chars" in given:
        given["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return rows.select(*given.values())


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = line_quality.judge(docs.select(_packed(docs), "text", "source"), carry=["doc"])
    text = line_quality.without_common_lines(F.col("doc.text"), F.col("common"))
    return _unpacked(judged.where("kept"), docs, text)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = materialise(
        docs.select(_packed(docs), F.monotonically_increasing_id().alias("row")), "numbered"
    )
    groups = ngram_join.near_copies(rows.select("row", "doc.text"), id_col="row")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row"))["row"]
    stays = (
        groups.select("row", "component_id").join(rows.select("row", "doc.doc_id"), "row")
        .groupBy("component_id").agg(best.alias("row")).select("row")
    )
    kept = rows.join(stays, "row", "left_semi")
    return kept.select(*[F.col("doc")[c].alias(c) for c in docs.columns])


@_stage
def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = suffixes.judged(docs.select(_packed(docs), "text"), ["doc"], keep=True)
    return _unpacked(judged, docs, F.coalesce("kept", "doc.text"))


@_stage
def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs, default_vocabulary(), PACKED_WORDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("repeated_strings", repeated_strings),
    ("mixed_sources", mixed_sources),
    ("packed", packed),
]

#: Tokenising and joins on similarity are not SQL; tested against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        docs = _keeping(spark, lambda made=made, name=name: materialise(made, name))
    name, stage = STAGES[-1]
    out = materialise(stage(spark, docs, sf_dir), name)
    _clean(out)
    return out
