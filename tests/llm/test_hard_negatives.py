import math
import random

import numpy as np
import pytest

from cloakframe.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, score string"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every=50):
    """All scores of all anchors, sorted."""
    ok = [(k, i, label, [math.floor(256 * float(np.float32(v))) for v in x]) for k, (i, label, x) in enumerate(rows) if None not in (i, label, x) and all(v is not None and math.isfinite(v) for v in x)]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for k, i, label, x in ok:
        if i % every:
            continue
        scored = sorted((-dot(x, y), j, m) for n, j, m, y in ok if n != k)
        for s, p, _ in [r for r in scored if r[2] == label][:5]:
            near = [r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            out += [(i, p, rank, j, -s, -t) for rank, (t, j, _) in enumerate(near, 1)]
    return sorted(out)


def found(spark, rows, parts=3, every=50):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in hn.hard_negatives(df, every).select(*NAMES).collect())


@pytest.mark.parametrize("chunk, block", [(8192, 4096), (40, 3)])
def test_equals_brute_force(spark, monkeypatch, chunk, block):
    """Ties, repeated vectors and ids, nulls, non-finite components and vectors of several lengths; one and many chunks."""
    monkeypatch.setattr(hn, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", block)
    r = random.Random(3)
    rows = [(k, r.randrange(4), [r.choice([-0.5, 0.25, 0.5, 0.75, 1.0, r.random()]) for _ in range(6)]) for k in range(300)]
    rows += [(k, 1, [0.5] * 6) for k in range(300, 380)]
    rows += [(400, None, [1.0]), (450, 2, None), (500, 2, [1.0, None]), (550, 2, [float("nan")]), (600, 2, [float("inf")]), (None, 2, [1.0]), (650, 3, []), (700, 2, [0.5, 0.5])]
    rows += [(50, rows[50][1], [0.5] * 6), (50, 3, [0.1] * 6)]
    assert found(spark, rows) == brute(rows)


def test_bounds_hold_every_score():
    r = np.random.default_rng(5)
    vectors = np.floor(256 * r.normal(size=(500, 16)))
    chunk = hn.Chunk.build(0, np.arange(500), np.zeros(500, np.int64), vectors)
    again = hn.Chunk.read(0, *chunk.row())
    anchors = np.floor(256 * r.normal(size=(20, 16))).astype(np.int32)
    low, high = again.bounds(anchors)
    exact = np.array([again.scores(np.arange(500), a.astype(np.float64)) for a in anchors])
    assert (low <= exact).all() and (exact <= high).all()
    best = np.sort(exact, axis=1)[:, -5:-4]
    assert (high >= best).mean() < 0.5  # most rows are never scored exactly


def test_empty_and_alone(spark):
    assert found(spark, []) == []
    assert found(spark, [(50, 1, [1.0])]) == []
    assert found(spark, [(50, 1, [1.0]), (51, 1, [-1.0]), (52, 2, [0.5])]) == []
    with pytest.raises(Exception, match="too large"):
        found(spark, [(50, 1, [1e6])])
