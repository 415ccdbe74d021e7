import math
import random

import numpy as np
import pytest
from rosterlane.llm import negatives
from rosterlane.llm.negatives import bounds, mine_negatives, op13_hard_negatives, open_windows

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def plain(rows):
    """The contract, anchor by anchor; repeated rows are rows of their own, by their order."""
    kept = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for at, (anchor, a, label) in enumerate(kept):
        if anchor % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(a, v, strict=False)), i, k, lb) for k, (i, v, lb) in enumerate(kept) if k != at)
        for p, i, _, lb in [s for s in scored if s[3] == label][:5]:
            fits = [s for s in scored if s[3] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(anchor, i, rank, s[1], -p, -s[0]) for rank, s in enumerate(fits, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "mine") for r in rows], SCHEMA)


def mined(df, **options):
    return sorted(map(tuple, mine_negatives(df, negatives.ANCHOR, negatives.LABEL, **options).collect()))


def random_rows(n, seed=4, values=(-0.5, -0.25, 0.0, 0.25, 0.5, 1.0)):
    rng = random.Random(seed)
    return [(i, [rng.choice(values) for _ in range(4)], rng.randint(0, 3)) for i in range(n)]


def test_query_against_a_plain_search(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted(map(tuple, op13_hard_negatives(spark, sf_dir).collect()))
    assert got == plain(rows) and got


def test_ties_in_many_partitions_and_blocks_of_anchors(spark):
    rows = random_rows(420)
    for df, together in ((frame(spark, rows).repartition(5), 8192), (frame(spark, rows).coalesce(1), 3)):
        assert mined(df, anchors_together=together) == plain(rows)


def test_positives_with_score_zero_take_negatives_with_score_zero(spark):
    rows = [(100, [0.0, 1.0], 1), (101, [1.0, 0.0], 1), (3, [1.0, 0.0], 2), (120, [2.0, 0.0], 2), (121, [0.0, 0.5], 2)]
    got = mined(frame(spark, rows))
    assert got == plain(rows) == [(100, 101, 1, 3, 0, 0), (100, 101, 2, 120, 0, 0)]


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(50, None, 1), (None, [1.0] * 4, 1), (51, [1.0, nan, 0.0, 0.0], 1), (52, [inf, 0.0, 0.0, 0.0], 1), (53, [1.0, None, 0.0, 0.0], 1), (54, [1.0] * 4, None), (57, [], 2), (58, [0.5, 0.5], 3), (59, [0.5] * 9, 3)]
    rows = [*random_rows(160, 9), *odd]
    assert mined(frame(spark, rows).coalesce(1)) == plain(rows)
    assert mined(frame(spark, rows[:160] + rows[:1])) == plain(rows[:160] + rows[:1])  # a repeated anchor
    assert mined(frame(spark, [])) == [] and mined(frame(spark, [(1, [1.0], 1)])) == []


def test_scores_beyond_doubles_are_exact():
    a = np.array([[2.0**40, 3.0]])
    assert negatives.inner(a, np.array([[2.0**20 + 1, 5.0]])).tolist() == [[2**40 * (2**20 + 1) + 15]]
    assert negatives.inner(a, np.array([[2.0**40, 1.0], [-(2.0**40), 1.0]])).tolist() == [[2**63 - 1, -(2**63)]]


@pytest.mark.parametrize("p", [-7, -1, 0, 1, 2, 3, 19, 20, 21, 1001])
def test_bounds_are_those_of_the_rule(p):
    low, high = bounds(p)
    assert [s for s in range(-1200, 1200) if 50 * p <= 100 * s <= 95 * p] == [s for s in range(-1200, 1200) if low <= s <= high]


def test_the_iterator_holds_open_windows_only():
    stream = iter([(0, 1, 10, 0, 5, 0), *((0, 1, 9, 1, i, i) for i in range(100000)), (0, 2, 4, 0, 7, 0), (0, 2, 3, 1, 8, 0)])
    assert list(open_windows(stream, 2)) == [(0, 5, 1, 0, 10, 9), (0, 5, 2, 1, 10, 9), (0, 7, 1, 8, 4, 3)]
