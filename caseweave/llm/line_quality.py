"""Quality rules: lines that too many documents of a host share are removed.

Only DataFrame functions run here. A document is a row; its host is a column.
Lines are normalised (white space at both ends dropped, letters in lower case)
and hashed to 64 bits. For each host the
number of *distinct texts* that hold a line is counted, so that copies of one
document make none of its lines common. A line is over the limit when more than
``max_share`` of the host's distinct texts hold it and at least ``min_texts``
do. A document is depleted, and rejected, when the lines over the limit hold
more than ``max_removed`` of the characters of its lines.

Defined cases: a null text has no words, counts zero everywhere and fails the
base rules; an empty or blank text likewise. A null host is a host of its own.
Repeated rows give repeated results, and count once as texts. Columns of the
input other than those named are carried only when asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm.common import BLANKS, bind, load, materialise, words_of

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
MIN_TEXTS = 10
MAX_SHARE = 0.10
MAX_REMOVED = 0.5
#: Columns that are added to those carried.
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_chars", "common",
    "base_failed", "kept",
)
#: Rows of one line are dealt over so many keys in the join that marks them.
SALTS = 16


def symbol_count(text: Column) -> Column:
    return F.size(F.split(text, SYMBOLS)) - 1


def repeated_words(words: Column) -> Column:
    """Number of words inside 3-word windows that the text holds at least twice.

    Windows are compared by a 64-bit hash of their three words. Only where any
    two are equal the hashes are sorted, and equal neighbours tell the repeated
    ones. Their places are then found by look-up in the list of repeated hashes
    while that is short, else by sorting hashes with places; both give the same.
    """

    def windows(w: Column) -> Column:
        return F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
        )

    def covered(places: Column) -> Column:
        return F.size(
            F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2))))
        )

    def placed(h: Column) -> Column:
        return F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))

    def by_sorting(h: Column) -> Column:
        def like(s: Column, x: Column, i: Column) -> Column:
            return F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))

        return bind(
            F.sort_array(placed(h)),
            lambda s: covered(
                F.filter(s, lambda x, i: like(s, x, i - 1) | like(s, x, i + 1))["i"]
            ),
        )

    def by_look_up(h: Column, twice: Column) -> Column:
        return covered(F.filter(placed(h), lambda x: F.array_contains(twice, x["h"]))["i"])

    def counted(h: Column) -> Column:
        twice = bind(
            F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1)))
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(
            bind(
                twice,
                lambda t: F.when(F.size(t) <= 64, by_look_up(h, t)).otherwise(by_sorting(h)),
            )
        )

    return bind(bind(words, windows), counted)


def _trimmed(x: Column) -> Column:
    return F.trim(x, F.lit(BLANKS))


def _line(x: Column) -> Column:
    """Hash and number of characters of one line after normalising."""
    t = _trimmed(x)
    return F.struct(F.xxhash64(F.lower(t)).alias("h"), F.length(t).alias("n"))


def _measured(text: Column) -> Column:
    return bind(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )


def _lined(text: Column) -> Column:
    worded = F.filter(F.split(text, "\n"), lambda x: F.length(_trimmed(x)) > 0)
    return bind(
        worded,
        lambda v: F.struct(
            (F.size(v) - F.size(F.array_distinct(v))).cast("long").alias("n_dup_lines"),
            F.transform(v, _line).alias("lines"),
        ),
    )


def measure(docs: DataFrame, text: str, host: str, carry: list[str]) -> DataFrame:
    """Row number, carried columns, base measures and hashed lines of each document; written."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.struct(*[F.col(c) for c in carry]).alias("_carried"),
        F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("")).alias("_host"),
        F.xxhash64(body).alias("_text"),
        _measured(body).alias("_words"),
        _lined(body).alias("_lines"),
        symbol_count(body).cast("long").alias("n_symbols"),
    )
    return materialise(rows, "measured")


def common_lines(
    rows: DataFrame, min_texts: int = MIN_TEXTS, max_share: float = MAX_SHARE
) -> DataFrame:
    """(host, line hash) of the lines over the limit, from the rows of ``measure``."""
    held = rows.select("_host", "_text", F.explode("_lines.lines.h").alias("h")).distinct()
    texts = rows.select("_host", "_text").distinct().groupBy("_host").agg(
        F.count("*").alias("_texts")
    )
    return (
        held.groupBy("_host", "h").agg(F.count("*").alias("_n"))
        .where(F.col("_n") >= min_texts)
        .join(texts, "_host")
        .where(F.col("_n") > F.col("_texts") * max_share)
        .select("_host", "h")
    )


def judge(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    carry: list[str] | None = None,
    min_texts: int = MIN_TEXTS,
    max_share: float = MAX_SHARE,
    max_removed: float = MAX_REMOVED,
) -> DataFrame:
    """Carried columns, base measures, ``n_removed_chars``, ``common`` (hashes of the document's
    lines over the limit), ``base_failed`` and ``kept`` for each document.

    Without *carry* all columns of *docs* are carried but those named like one of these."""
    carried = carry or [c for c in docs.columns if c not in MEASURES]
    rows = measure(docs, text, host, carried)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    limits = common_lines(rows, min_texts, max_share).select("*", salts)
    marked = (
        rows.select("_row", "_host", F.explode("_lines.lines").alias("l"))
        .select("_row", "_host", "l.h", "l.n", F.pmod(F.hash("_row"), F.lit(SALTS)).alias("_salt"))
        .join(limits, ["_host", "h", "_salt"])
        .groupBy("_row")
        .agg(
            F.sum("n").cast("long").alias("n_removed_chars"),
            F.collect_set("h").alias("common"),
        )
    )
    words, repeats = F.col("_words.n_words"), F.col("_words.n_repeat_words")
    failed = (words < MIN_WORDS) | (100 * repeats > MAX_REPEATED * words)
    chars = F.aggregate(
        F.col("_lines.lines"), F.lit(0).cast("long"), lambda total, x: total + x["n"]
    )
    removed = F.coalesce("n_removed_chars", F.lit(0).cast("long"))
    return rows.join(marked, "_row", "left").select(
        "_carried.*", "_words.n_words", "_words.word_chars", "n_symbols", "_lines.n_dup_lines",
        "_words.n_repeat_words", removed.alias("n_removed_chars"), "common",
        failed.alias("base_failed"),
        (~failed & (removed <= max_removed * chars)).alias("kept"),
    )


def without_common_lines(text: Column, common: Column) -> Column:
    """*text* less its lines over the limit; other lines stay as they are."""
    left = F.filter(
        F.split(text, "\n"), lambda x: ~F.array_contains(common, _line(x)["h"])
    )
    return F.when(F.size(common) > 0, F.array_join(left, "\n")).otherwise(text)


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "documents"), carry=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_removed_chars", "base_failed", "kept",
    )


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
l AS (SELECT r, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT r, source, t, line, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS k FROM l
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY r),
key AS (SELECT r, source, t, lower(k) AS k, length(k) AS n FROM lw),
held AS (SELECT source, k, count(DISTINCT t) AS n FROM key GROUP BY ALL),
host AS (SELECT source, count(DISTINCT t) AS n FROM d GROUP BY ALL),
over_limit AS (SELECT held.source, held.k FROM held JOIN host ON held.source IS NOT DISTINCT FROM host.source
           WHERE held.n >= 10 AND held.n > host.n * CAST(0.1 AS DOUBLE)),
gone AS (SELECT key.r, sum(key.n) AS n FROM key JOIN over_limit o
           ON key.source IS NOT DISTINCT FROM o.source AND key.k = o.k GROUP BY key.r),
chars AS (SELECT r, sum(n) AS n FROM key GROUP BY r),
pos AS (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w),
win AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS x FROM pos),
twin AS (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM win),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twin WHERE c > 1) GROUP BY r),
m AS (SELECT d.doc_id, len(w.ws) AS n_words, CAST(coalesce(list_sum(list_transform(w.ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
        coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_chars
, coalesce(chars.n, 0) AS n_chars
      FROM d JOIN w USING (r) LEFT JOIN chars USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT * EXCLUDE (n_chars), NOT base_failed AND n_removed_chars <= 0.5 * n_chars AS kept FROM f
"""
