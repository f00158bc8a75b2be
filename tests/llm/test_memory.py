"""What the steps on pairs of texts hold in a worker at their full sizes, which do not grow with the tables."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from cohortlens.llm import overlap, packing, simhash, words


def peak_mb(work):
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        work()
        return (tracemalloc.get_traced_memory()[1] - before) / 1e6
    finally:
        tracemalloc.stop()


@pytest.fixture
def rng():
    return np.random.default_rng(1)


def numbers(rng, n):
    return rng.integers(0, 2 ** 62, n).astype(np.uint64)


def test_a_part_of_fingerprint_keys(rng):
    n = simhash.PART_KEYS
    payload = packing.pack(numbers(rng, n), rng.integers(0, 64, n).astype(np.uint8))
    frame = pd.DataFrame({"part": [0], "payload": [payload]})
    assert peak_mb(lambda: simhash._links(4)(frame)) < 150


def test_offered_fingerprints(rng):
    frames = [pd.DataFrame({"fp": numbers(rng, 10_000).astype(np.int64)}) for _ in range(-(-simhash.OFFER_ROWS // 10_000))]
    assert peak_mb(lambda: list(simhash._offers(4, 8)(iter(frames)))) < 150


def test_a_part_of_band_codes(rng):
    n = overlap.PART_ENTRIES
    empty = np.empty(0, np.int64)
    payload = packing.pack(numbers(rng, n), numbers(rng, n).astype(np.int64), *(numbers(rng, n) for _ in range(3)), empty, empty)
    assert peak_mb(lambda: overlap._meet(pd.DataFrame({"payload": [payload]}))) < 150


def test_dealt_classes(rng):
    frames = [pd.DataFrame({"node": numbers(rng, 1000).astype(np.int64), "codes": list(numbers(rng, 32_000).astype(np.int64).reshape(-1, 32)),
                            "sketch": list(numbers(rng, 3000).astype(np.int64).reshape(-1, 3))}) for _ in range(overlap.DEALT // 1000)]
    assert peak_mb(lambda: list(overlap._deal(8, {})(iter(frames)))) < 150


def test_batches_give_back_what_is_free(monkeypatch):
    import pyarrow as pa
    calls = []
    monkeypatch.setattr(words, "give_back", lambda: calls.append(1), raising=False)
    batch = pa.RecordBatch.from_pydict({"text": ["a", None, "b"]})
    assert sum(b.num_rows for b in words.small_batches(iter([batch, batch]), "text")) == 6 and calls == [1]
