"""Edit distance, longest common subsequence, alignment and token counts of list pairs.

Distance, subsequence and alignment need a dynamic program whose cells depend on
each other, which array expressions can only do by copying a row per cell. Here
the pairs of one Arrow batch are solved together: each row of the program is a
few numpy operations over all pairs, the left-to-right dependency being a
running minimum or maximum.

Pairs whose matrices fit ``_CELLS`` together keep them for the walk back. A pair
that does not fit alone keeps every k-th row, k being the root of their number,
and the walk back makes the rows between two kept ones again as it comes to
them. So memory is a few hundred rows even for lists of tens of thousands of
tokens, at the price of computing each row twice; ties are broken the same way.

Token counts and rank agreement sort the tokens' codes instead of comparing all
with all, for the whole batch at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cells of DP matrices held at a time.
_CELLS = 4_000_000

_RESULT = T.StructType([
    T.StructField("edit_distance", T.IntegerType()),
    T.StructField("lcs_length", T.IntegerType()),
    T.StructField("true_at", T.ArrayType(T.IntegerType())),
    T.StructField("pred_at", T.ArrayType(T.IntegerType())),
])
_TALLY = T.StructType([
    T.StructField("counts", T.ArrayType(T.StructType([
        T.StructField("token", T.StringType()),
        T.StructField("n_true", T.IntegerType()),
        T.StructField("n_pred", T.IntegerType()),
    ]))),
    T.StructField("n_shared", T.IntegerType()),
    T.StructField("n_discordant", T.LongType()),
])


def _lists(*columns: Column) -> list[Column]:
    empty = F.array().cast("array<string>")
    return [F.coalesce(c, empty) for c in columns]


def align(true: Column, pred: Column) -> Column:
    """Struct of edit distance, LCS length and the alignment as 1-based positions.

    A position of 0 is a gap: ``true_at = 0`` is an insertion, ``pred_at = 0`` a
    deletion. Among equally cheap alignments the walk back from the end takes a
    match or substitution first, then a deletion, then an insertion.
    """
    return _align(*_lists(true, pred))


def tally(true: Column, pred: Column) -> Column:
    """Struct of token counts and of rank agreement.

    ``counts`` has (token, n_true, n_pred) for the distinct tokens of both lists
    in order of first occurrence; ``n_shared`` is the number of tokens both
    have, ``n_discordant`` the number of pairs of these whose first positions
    are in different order.
    """
    return _tally(*_lists(true, pred))


@F.arrow_udf(_RESULT)
def _align(true: pa.Array, pred: pa.Array) -> pa.Array:
    n, m = _lengths(true), _lengths(pred)
    codes = _token_codes(true, pred).indices.to_numpy(zero_copy_only=False)
    true_codes, pred_codes = codes[: n.sum()], codes[n.sum():]
    true_start, pred_start = np.cumsum(n) - n, np.cumsum(m) - m

    rows = len(n)
    distance = np.zeros(rows, np.int32)
    lcs = np.zeros(rows, np.int32)
    parts, sizes, steps = [], [], []
    for part in _batches(n, m):
        a = _padded(true_codes, true_start[part], n[part], -1)
        b = _padded(pred_codes, pred_start[part], m[part], -2)
        distance[part], lcs[part], size, path = _solve(a, b, n[part], m[part])
        parts.append(part)
        sizes.append(size)
        steps.append(path)
    parts = np.concatenate([np.zeros(0, np.int64), *parts])
    size = np.concatenate([np.zeros(0, np.int64), *sizes])
    steps = np.concatenate([np.zeros((0, 2), np.int32), *steps])
    # paths come by batch; put them in the order of the rows
    starts, lengths = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    starts[parts], lengths[parts] = np.cumsum(size) - size, size
    ends = np.cumsum(lengths)
    steps = steps[np.repeat(starts - (ends - lengths), lengths) + np.arange(len(steps))]
    offsets = pa.array(np.append(0, ends).astype(np.int32))
    return pa.StructArray.from_arrays(
        [
            pa.array(distance),
            pa.array(lcs),
            pa.ListArray.from_arrays(offsets, pa.array(steps[:, 0])),
            pa.ListArray.from_arrays(offsets, pa.array(steps[:, 1])),
        ],
        names=["edit_distance", "lcs_length", "true_at", "pred_at"],
    )


@F.arrow_udf(_TALLY)
def _tally(true: pa.Array, pred: pa.Array) -> pa.Array:
    n, m = _lengths(true), _lengths(pred)
    rows = len(n)
    encoded = _token_codes(true, pred)
    code = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.concatenate([np.repeat(np.arange(rows), n), np.repeat(np.arange(rows), m)])
    place = np.concatenate([_within(n), np.repeat(n, m) + _within(m)])
    in_pred = np.arange(len(code)) >= n.sum()

    # tokens of a row side by side, each one's occurrences in order of place
    order = np.lexsort((place, code, row))
    row, code, place, in_pred = row[order], code[order], place[order], in_pred[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    first = np.flatnonzero(new)
    n_pred = np.add.reduceat(in_pred, first, dtype=np.int32) if len(first) else np.zeros(0, np.int32)
    n_true = np.diff(np.append(first, len(row))).astype(np.int32) - n_pred
    group = np.cumsum(new) - 1
    # the first occurrence in pred follows the last in true
    in_both = (n_true > 0) & (n_pred > 0)
    pred_place = place[np.minimum(first + n_true, max(len(place) - 1, 0))] if len(first) else first
    shared = np.flatnonzero(in_both)
    shared = shared[np.lexsort((place[first[shared]], row[first[shared]]))]
    n_shared = np.bincount(row[first[shared]], minlength=rows)
    discordant = _inversions(row[first[shared]], n_shared, pred_place[shared], rows)

    shown = np.lexsort((place[first], row[first]))
    token = encoded.dictionary.take(encoded.indices.take(pa.array(order[first[shown]])))
    offsets = np.append(0, np.cumsum(np.bincount(row[first], minlength=rows)))
    counts = pa.StructArray.from_arrays(
        [token.cast(pa.string()), pa.array(n_true[shown]), pa.array(n_pred[shown])],
        names=["token", "n_true", "n_pred"],
    )
    return pa.StructArray.from_arrays(
        [
            pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), counts),
            pa.array(n_shared.astype(np.int32)),
            pa.array(discordant),
        ],
        names=["counts", "n_shared", "n_discordant"],
    )


def _inversions(owner, sizes, values, rows) -> np.ndarray:
    """Per owner the number of pairs out of order; values come by owner, in the owner's order.

    Merging from below, for all owners at once: blocks of doubling width are
    sorted, and each value of a right half counts the larger ones of its left
    half, which the sort puts behind it.
    """
    total = np.zeros(rows, np.int64)
    at = _within(sizes)
    width = 1
    while True:
        open_ = sizes[owner] > width
        if not open_.any():
            return total
        owner, at, values = owner[open_], at[open_], values[open_]
        block = at // (2 * width)
        right = (at // width) % 2 == 1
        order = np.lexsort((values, block, owner))
        o, k, r = owner[order], block[order], right[order]
        left_so_far = np.cumsum(~r)
        new = np.ones(len(o), bool)
        new[1:] = (o[1:] != o[:-1]) | (k[1:] != k[:-1])
        ends = np.append(np.flatnonzero(new)[1:], len(o)) - 1
        behind = left_so_far[ends][np.cumsum(new) - 1] - left_so_far
        np.add.at(total, o[r], behind[r])
        width *= 2


def _token_codes(true: pa.Array, pred: pa.Array) -> pa.DictionaryArray:
    both = pa.concat_arrays([true.flatten(), pred.flatten()])
    return pc.dictionary_encode(both, null_encoding="encode")


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the sizes, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(sizes.sum()) - np.repeat(ends - sizes, sizes)


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _batches(n: np.ndarray, m: np.ndarray):
    """Rows of similar size together, cut so that the padded matrices stay small."""
    order = np.lexsort((m, n))
    start = 0
    while start < len(order):
        width = high = 0
        stop = start
        while stop < len(order):
            high = max(high, n[order[stop]] + 1)
            width = max(width, m[order[stop]] + 1)
            if stop > start and (stop - start + 1) * high * width > _CELLS:
                break
            stop += 1
        yield order[start:stop]
        start = stop


def _padded(codes, start, length, fill):
    width = int(length.max(initial=0))
    column = np.arange(width)
    inside = column < length[:, None]
    out = np.full((len(length), width), fill, np.int32)
    out[inside] = codes[(start[:, None] + column)[inside]]
    return out


def _row_after(above, i, code, b, column):
    """Row *i* of the distances, from the row above and the pairs' i-th tokens."""
    row = np.empty_like(above)
    row[:, 0] = i
    np.minimum(above[:, 1:] + 1, above[:, :-1] + (code[:, None] != b), out=row[:, 1:])
    row -= column
    np.minimum.accumulate(row, axis=1, out=row)
    row += column
    return row


def _solve(a, b, n, m):
    """Distance, LCS length, length of the path, and the paths one after the other."""
    rows, height, width = len(n), a.shape[1], b.shape[1]
    column = np.arange(width + 1, dtype=np.int32)
    fits = rows * (height + 1) * (width + 1) <= _CELLS
    every = 1 if fits else int(np.ceil(np.sqrt(height + 1)))
    row = np.tile(column, (rows, 1))
    kept = [row]
    common = np.zeros((rows, width + 1), np.int32)
    distance, lcs = m.astype(np.int32), np.zeros(rows, np.int32)
    for i in range(1, height + 1):
        row = _row_after(row, i, a[:, i - 1], b, column)
        if i % every == 0:
            kept.append(row)
        grown = common.copy()
        grown[:, 1:] = np.maximum(common[:, 1:], (common[:, :-1] + 1) * (a[:, i - 1, None] == b))
        common = np.maximum.accumulate(grown, axis=1)
        done = np.flatnonzero(n == i)
        distance[done] = row[done, m[done]]
        lcs[done] = common[done, m[done]]

    def stretches():
        """(first row, rows from it on) from the end of the matrix to its beginning."""
        if fits:
            yield 0, kept
            return
        last = height
        while last > 0:
            first = (last - 1) // every * every
            made = [kept[first // every]]
            for i in range(first + 1, last + 1):
                made.append(_row_after(made[-1], i, a[:, i - 1], b, column))
            del kept[first // every + 1 :]
            yield first, made
            last = first
        if height == 0:
            yield 0, kept

    size, path = _trace(stretches(), a, b, n, m)
    return distance, lcs, size, path


def _trace(stretches, a, b, n, m):
    """Walk all pairs of the batch back together, one step per round."""
    i, j = n.copy(), m.copy()
    index = np.arange(len(n))
    taken = []
    for first, rows in stretches:
        matrix = np.stack(rows)
        while True:
            # insertions along the first row belong to the stretch before, if there is one
            live = (i > first) | ((j > 0) & (i == first) & (first == 0))
            if not live.any():
                break
            at = np.clip(i - first, 0, len(rows) - 1)
            here = matrix[at, index, j]
            above, left = np.maximum(at - 1, 0), np.maximum(j - 1, 0)
            both = live & (i > 0) & (j > 0)
            differs = np.ones(len(n), bool)
            differs[both] = a[index[both], i[both] - 1] != b[index[both], left[both]]
            diagonal = both & (here == matrix[above, index, left] + differs)
            delete = live & ~diagonal & (i > 0) & (here == matrix[above, index, j] + 1)
            insert = live & ~diagonal & ~delete
            taken.append((np.where(diagonal | delete, i, 0), np.where(diagonal | insert, j, 0)))
            i = i - (diagonal | delete)
            j = j - (diagonal | insert)
    if not taken:
        return np.zeros(len(n), np.int64), np.zeros((0, 2), np.int32)
    # (pair, step, side), oldest position first
    walked = np.array(taken, np.int32)[::-1].transpose(2, 0, 1)
    there = walked.any(axis=2)
    return there.sum(axis=1), walked[there]
