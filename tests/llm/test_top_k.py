"""Bounds drop most pairs where vectors lie in groups, and never a true result."""

import numpy as np
import pytest

from gridspark.llm import topk


def _plain(x, ids, q, query_ids, k):
    out = set()
    for row, own in zip(q, query_ids):
        scores = x @ row
        order = sorted((-int(s), int(i)) for s, i in zip(scores, ids) if i != own)[:k]
        out |= {(int(own), i, -s) for s, i in order}
    return out


@pytest.mark.parametrize("groups, spread, most", [(12, 6, 0.5), (1, 60, 1.0)])
def test_blocks_against_all_products(groups, spread, most):
    rng = np.random.default_rng(groups)
    centres = rng.integers(-150, 150, (groups, 32))
    x = centres[rng.integers(0, groups, 6000)] + rng.integers(-spread, spread + 1, (6000, 32))
    x[100:140] = x[100]  # ties
    ids = rng.permutation(6000)
    asked = ids % 40 == 0
    q, query_ids = x[asked], ids[asked]
    norms = np.sqrt((q.astype(float) ** 2).sum(1))
    best, resolved = (np.empty(0, np.int64),) * 3, 0
    blocks = topk._blocks(x, ids, float(np.abs(x).max()) ** 2 * 32)
    tops = np.stack([b.best(q, norms) for b in blocks])
    for b in np.argsort(-tops.max(1), kind="stable").tolist():
        assert (tops[b][:, None] >= q @ blocks[b].whole[:, np.argsort(blocks[b].order)].T).all()
        floor = np.full(len(q), -np.inf)
        n = np.bincount(best[0], minlength=len(q))
        full = np.flatnonzero(n >= 20)
        floor[full] = best[2][np.cumsum(n)[full] - 1]
        alive = np.flatnonzero(tops[b] >= floor)
        if len(alive):
            (at, i, s), some = topk.nra_block(blocks[b], q[alive], query_ids[alive], floor[alive], 20)
            best, resolved = topk._keep_best(best, (alive[at], i, s), 20), resolved + some
    assert {(int(query_ids[a]), int(i), int(s)) for a, i, s in zip(*best)} == _plain(x, ids, q, query_ids, 20)
    assert resolved <= most * len(q) * len(x)


@pytest.mark.parametrize("scale", [1, 1 << 16, 1 << 20])  # the last one fills 63 bits
def test_large_components_stay_exact(spark, scale):
    """Products beyond what floats hold exactly."""
    rng = np.random.default_rng(scale % 97)
    x = rng.integers(-1000, 1000, (300, 6)) * scale + rng.integers(0, 7, (300, 6))
    df = spark.createDataFrame([(i, [int(c) for c in v]) for i, v in enumerate(x)], "vec_id long, v array<long>")
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), k=5, chunk=7).collect()
    ids = np.arange(300)
    assert {(r.query_id, r.vec_id, r.score) for r in got} == _plain(x, ids, x[::20], ids[::20], 5)
