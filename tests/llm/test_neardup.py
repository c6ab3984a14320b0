"""Links of near-duplicates that rounds by hubs lost, in tiles of any size."""

import numpy as np
import pytest

from kithmesh.llm import neardup


@pytest.fixture
def small_tiles(monkeypatch):
    for name, value in (("TILE_NODES", 64), ("TILE_SHINGLES", 64 * 250), ("HUB_NODES", 50)):
        monkeypatch.setattr(neardup, name, value)


def crowd(n):
    """Texts of 254 words that differ in six places, likeness 0.786; 200 and 300 share one of them, likeness 0.818."""
    texts = []
    for d in range(n):
        words = [f"b2x{k}" for k in range(254)]
        for k in range(6):
            words[20 + 40 * k] = f"e2x{200 if k == 0 and d == 300 else d}x{k}"
        texts.append(" ".join(words))
    return list(enumerate(texts))


def test_one_link_among_many_texts_just_below_the_threshold(spark):
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(crowd(400), "doc_id long, text string")).collect()}
    assert got == {k: 200 if k == 300 else k for k in range(400)}


def test_blocks_of_a_bucket_meet_in_tiles(spark, small_tiles):
    rows = crowd(320)
    rows += [(k + 1000, t.replace(" b2x0 ", " ").replace("b2x253", f"c{k}") + (" again" * 9 if k % 3 else "")) for k, t in rows[:20]]  # near copies, some with weights
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: 200 if k == 300 else k % 1000 for k, _ in rows}
    assert {r["doc_id"] for r in neardup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()} == set(range(320)) - {300}


def test_bound_of_the_likeness():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = np.sort(rng.choice(60, rng.integers(2, 40), replace=False))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.choice(60, 3)]))
        wa, wb = rng.integers(1, 4, len(a)).astype(float), rng.integers(1, 4, len(b)).astype(float)
        x = np.zeros(60)
        x[a] = wa / wa.sum()
        bound = neardup._most_alike(x[b], wb / wb.sum(), np.array([0]), np.array([len(b)]))[0]
        assert bound >= neardup.likeness(a.astype(np.uint64), wa, b.astype(np.uint64), wb) - 1e-12
