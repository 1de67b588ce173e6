import math
import random
from collections import Counter
from functools import lru_cache

import pytest

from caseweave.functions import alignment
from caseweave.functions.sequences import with_pair_metrics

EDGES = [
    ([], []), (["a"], []), ([], ["a"]), (["a"], ["a"]), (["a"], ["b"]),
    (["a", "b", "c"], ["c", "b", "a"]), (["a", "a", "b"], ["a", "b", "b"]),
    (["a", "b"], ["a", "b", "b"]), (["a", "b"], ["b", "a"]), (["a", "b"], ["a"]),
    (["a"], ["a", "c"]), (["a", "b", "a", "c"], ["b", "a", "c", "a", "d"]),
]


def random_pairs(n, longest, seed):
    rng = random.Random(seed)
    return [
        tuple([rng.choice("abcde") for _ in range(rng.randrange(longest))] for _ in range(2))
        for _ in range(n)
    ]


def distance(a, b):
    @lru_cache(None)
    def d(i, j):
        if not i or not j:
            return i + j
        return min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))

    return d(len(a), len(b))


def common(a, b):
    @lru_cache(None)
    def c(i, j):
        if not i or not j:
            return 0
        return c(i - 1, j - 1) + 1 if a[i - 1] == b[j - 1] else max(c(i - 1, j), c(i, j - 1))

    return c(len(a), len(b))


def walk_back(a, b):
    """The alignment by the stated preference, from the distances of prefixes."""
    i, j, out = len(a), len(b), []
    while i or j:
        here = distance(a[:i], b[:j])
        if i and j and here == distance(a[:i - 1], b[:j - 1]) + (a[i - 1] != b[j - 1]):
            out.append((a[i - 1], b[j - 1]))
            i, j = i - 1, j - 1
        elif i and here == distance(a[:i - 1], b[:j]) + 1:
            out.append((a[i - 1], None))
            i -= 1
        else:
            out.append((None, b[j - 1]))
            j -= 1
    return out[::-1]


def scored(spark, pairs):
    df = spark.createDataFrame(
        [(i, *p) for i, p in enumerate(pairs)], "i int, t array<string>, p array<string>"
    )
    return [r.asDict(True) for r in with_pair_metrics(df, "t", "p").orderBy("i").collect()]


@pytest.fixture(scope="module")
def results(spark):
    pairs = EDGES + random_pairs(300, 8, seed=1)
    return list(zip(pairs, scored(spark, pairs)))


def test_distance_lcs_and_alignment_against_brute_force(results):
    for (t, p), r in results:
        assert r["edit_distance"] == distance(tuple(t), tuple(p))
        assert r["lcs_length"] == common(tuple(t), tuple(p))
        assert [(s["true"], s["pred"]) for s in r["alignment"]] == walk_back(tuple(t), tuple(p))


def test_alignment_adds_up(results):
    for (t, p), r in results:
        ops = r["ops"]
        assert ops["sub"] + ops["ins"] + ops["del"] == r["edit_distance"]
        assert sum(ops.values()) == len(r["alignment"])
        assert ops["sub"] == len(r["subs"])


def test_overlap_measures(results):
    for (t, p), r in results:
        ct, cp = Counter(t), Counter(p)
        overlap = sum((ct & cp).values())
        assert r["multiset_precision"] == (overlap / len(p) if p else float(not t))
        assert r["multiset_recall"] == (overlap / len(t) if t else float(not p))
        assert r["lcs_length"] <= overlap
        assert r["fp"] == dict(cp - ct) and r["fn"] == dict(ct - cp)
        union = set(t) | set(p)
        assert r["jaccard"] == (len(set(t) & set(p)) / len(union) if union else 1.0)
        assert math.isclose(r["dice"], 2 * r["jaccard"] / (1 + r["jaccard"]))
        dot = sum(ct[x] * cp[x] for x in ct)
        norms = math.sqrt(sum(v * v for v in ct.values())) * math.sqrt(sum(v * v for v in cp.values()))
        assert math.isclose(r["cosine"], 1.0 if not union else dot / norms if norms else 0.0)


def test_sequence_precision_at_empty_sides(results):
    by_pair = {(tuple(t), tuple(p)): r for (t, p), r in results}
    assert by_pair[(), ()]["seq_f1"] == 1.0 and by_pair[(), ()]["normalized_edit_distance"] == 0.0
    assert by_pair[("a",), ()]["seq_f1"] == 0.0 and by_pair[(), ("a",)]["lcs_ratio"] == 0.0


def test_categories(results):
    by_pair = {(tuple(t), tuple(p)): r["category"] for (t, p), r in results}
    assert by_pair[("a",), ("a",)] == "exact"
    assert by_pair[("a", "b"), ("b", "a")] == "ordering"
    assert by_pair[("a", "b"), ("a", "b", "b")] == "multiplicity(over)"
    # same length, same types, other counts: counted as "under"
    assert by_pair[("a", "a", "b"), ("a", "b", "b")] == "multiplicity(under)"
    assert by_pair[("a",), ("a", "c")] == "over-generation"
    assert by_pair[("a", "b"), ("a",)] == "under-generation"
    assert by_pair[("a",), ("b",)] == "substitution/mixed"


def test_kendall(results):
    for (t, p), r in results:
        shared = [x for x in dict.fromkeys(t) if x in p]
        pairs = [(x, y) for i, x in enumerate(shared) for y in shared[i + 1:]]
        if not pairs:
            assert r["kendall_tau"] == 1.0
            continue
        agree = sum(1 if p.index(x) < p.index(y) else -1 for x, y in pairs)
        assert math.isclose(r["kendall_tau"], agree / len(pairs))


def test_batches_are_cut_without_changing_results(spark, monkeypatch):
    import numpy as np

    lengths = np.array([3, 0, 90, 4, 7]), np.array([2, 5, 80, 0, 7])
    monkeypatch.setattr(alignment, "_CELLS", 50)
    parts = list(alignment._batches(*lengths))
    assert sorted(np.concatenate(parts).tolist()) == [0, 1, 2, 3, 4] and len(parts) > 1
    long = random_pairs(4, 120, seed=2)
    for (t, p), r in zip(long, scored(spark, long)):
        assert r["edit_distance"] == distance(tuple(t), tuple(p))


def solved(pairs):
    """Distance, LCS and path of each pair, solved as one batch."""
    import numpy as np

    n, m = (np.array([len(p[side]) for p in pairs]) for side in (0, 1))
    a = np.full((len(pairs), n.max()), -1, np.int32)
    b = np.full((len(pairs), m.max()), -2, np.int32)
    for k, (t, p) in enumerate(pairs):
        a[k, : len(t)], b[k, : len(p)] = t, p
    distances, lengths, sizes, steps = alignment._solve(a, b, n, m)
    return list(zip(distances.tolist(), lengths.tolist(), np.split(steps, np.cumsum(sizes)[:-1])))


@pytest.mark.parametrize("sizes", [(1, 1), (1, 40), (40, 1), (37, 41), (0, 9), (9, 0), (300, 250)])
def test_rows_made_again_give_the_same_path(monkeypatch, sizes):
    import numpy as np

    rng = np.random.default_rng(sum(sizes))
    pair = tuple(rng.integers(0, 4, n).tolist() for n in sizes)
    [whole] = solved([pair])
    monkeypatch.setattr(alignment, "_CELLS", 1)
    [again] = solved([pair])
    assert again[:2] == whole[:2] and np.array_equal(again[2], whole[2])


def test_lists_of_twenty_thousand_tokens_in_little_memory():
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(6)
    true = rng.integers(0, 500, 20_000)
    pred = np.delete(np.where(rng.random(20_000) < 0.02, 999, true), rng.integers(0, 20_000, 300))
    tracemalloc.start()
    [(edits, same, path)] = solved([(true, pred)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    kept = path[path.all(axis=1)] - 1
    equal = int((true[kept[:, 0]] == pred[kept[:, 1]]).sum())
    assert edits == len(path) - equal and equal <= same
    for side, size in ((0, 20_000), (1, len(pred))):
        assert (path[path[:, side] > 0, side] == np.arange(1, size + 1)).all()


def test_counts_of_fifty_thousand_tokens(spark):
    import time

    from pyspark.sql import functions as F

    rng = random.Random(3)
    true = [str(rng.randrange(60_000)) for _ in range(50_000)]
    pred = [str(rng.randrange(60_000)) for _ in range(50_000)]
    df = spark.createDataFrame([(true, pred), (pred[:9], pred[:9]), (None, true[:1])], "t array<string>, p array<string>")
    start = time.time()
    got, small, null = [r[0] for r in df.select(alignment.tally(F.col("t"), F.col("p"))).collect()]
    assert time.time() - start < 30
    counts = Counter(true), Counter(pred)
    assert [(c.token, c.n_true, c.n_pred) for c in got.counts] == [
        (x, counts[0][x], counts[1][x]) for x in dict.fromkeys(true + pred)
    ]
    place = {}
    for i, x in enumerate(pred):
        place.setdefault(x, i)
    ranks = [place[x] for x in dict.fromkeys(true) if x in place]
    ahead, discordant = [], 0
    import bisect

    for r in ranks:
        discordant += len(ahead) - bisect.bisect(ahead, r)
        bisect.insort(ahead, r)
    assert (got.n_shared, got.n_discordant) == (len(ranks), discordant)
    assert (small.n_shared, small.n_discordant) == (len(set(pred[:9])), 0)
    assert (null.n_shared, len(null.counts)) == (0, 1)
