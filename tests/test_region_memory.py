"""Memory of a task that assigns vectors to regions."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from kinspot.operators import regions


def test_regions_are_assigned_within_bounded_memory():
    centres = np.eye(8)[np.arange(4096) % 8] + 1e-3 * np.arange(4096)[:, None]
    vectors = np.random.default_rng(3).normal(size=(4000, 8))
    offsets = pa.array(np.arange(0, vectors.size + 1, 8, dtype=np.int32))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4000)), pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))], names=["doc_id", "unit_vec"])
    tracemalloc.start()
    parts = list(regions._assign(centres)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # all rows by all centres are 131 MB
    unit = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    found = pa.Table.from_batches(parts)
    assert found["doc_id"].to_pylist() == list(range(4000))
    assert found["region"].to_numpy().tolist() == (vectors @ unit.T / np.linalg.norm(vectors, axis=1)[:, None]).argmax(1).tolist()
