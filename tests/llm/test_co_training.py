"""Both views hand over rows, and labels that no fit has seen are met."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.llm import quality

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def kept_out(spark):
    """A model without a quarter of the labels, its exchange, and the scores of that quarter."""
    documents, labels = (spark.read.parquet(f"{BIG}/{n}.parquet") for n in ("documents", "labels"))
    quarter = F.pmod(F.xxhash64(F.lit(99), "doc_id"), F.lit(4)) == 0
    log, plain = [], quality.exchange

    def noted(*args):
        out = plain(*args)
        log.extend(out[1])
        return out

    quality.exchange = noted
    try:
        model = quality.co_train(documents, labels.where(~quarter))
    finally:
        quality.exchange = plain
    truth = labels.where(quarter).groupBy("doc_id").agg((F.min("quality") == 1) & (F.max("toxic") == 0))
    rows = model.score(documents).join(truth.toDF("doc_id", "good"), "doc_id").collect()
    return log, rows


def test_both_views_hand_over_rows(kept_out):
    log, _ = kept_out
    assert len(log) == quality.ROUNDS and all(a > 0 and b > 0 for a, b in log)


def test_accuracy_on_labels_kept_out(kept_out):
    _, rows = kept_out
    good = np.array([r.good for r in rows])
    right = {c: np.mean((np.array([r[c] for r in rows]) >= 0.5) == good) for c in quality.SCORES}
    base = max(good.mean(), 1 - good.mean())
    assert right["score"] > base + 0.1
    assert right["score"] >= max(right["text_score"], right["metadata_score"]) - 1e-9
    assert right["metadata_score"] > base  # the metadata view tells something of its own
    kept = np.array([r.score >= quality.KEEP_SCORE for r in rows])
    assert kept[good].mean() > 0.85 and kept[~good].mean() < 0.2


def test_an_exchange_without_a_pool():
    rng = np.random.default_rng(0)
    n = 200
    y = (np.arange(n) % 2).astype(float)
    one = quality.Sparse(np.arange(n) % 2, np.arange(n + 1), np.ones((n, 1)))
    noise = quality.Sparse(rng.integers(2, 5, n), np.arange(n + 1), np.ones((n, 1)))
    held = np.arange(n) % 5 == 0
    model, handed = quality.exchange(one, noise, y, np.where(held, np.nan, y), held, 2)
    assert handed == [(0, 0), (0, 0)]
    assert ((one.margins(model.text) > 0) == (y > 0)).all()
