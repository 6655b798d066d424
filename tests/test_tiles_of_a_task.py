"""Counts of similarities leave a task once, however many tiles it holds, and tiles may lie across batches."""

import numpy as np
import pyarrow as pa

from lexmill.operators import pair_ranks as pr


def batches_of(rows, size):
    table = pa.table({
        "lo": pa.array([r[0] for r in rows], pa.int32()), "hi": pa.array([r[1] for r in rows], pa.int32()), "first": [r[2] for r in rows],
        "u": pa.array([r[3] for r in rows], pa.list_(pa.float64())), "v": pa.array([r[4] for r in rows], pa.list_(pa.float64())),
    })
    return iter(table.to_batches(max_chunksize=size))


def test_one_count_for_all_tiles():
    rng = np.random.default_rng(4)
    u, v = rng.normal(size=(40, 5)), rng.normal(size=(40, 3))
    u, v = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (u, v))
    own, rows = np.arange(40) % 4, []
    for lo in range(4):
        for hi in range(lo, 4):
            rows += [(lo, hi, bool(own[i] == lo), u[i].tolist(), v[i].tolist()) for i in range(40) if own[i] in (lo, hi)]
    lower = np.tril_indices(40, k=-1)
    for size in (3, 1000):
        for scale in (10, 10_000):
            out = list(pr._counts(scale)(batches_of(rows, size)))
            keys = [(b.column("side")[0].as_py(), b.column("chunk")[0].as_py()) for b in out]
            assert len(keys) == len(set(keys)) <= 2 * (2 * scale // pr.CHUNK + 1)
            counts = np.zeros((2, 2 * scale // pr.CHUNK + 1, pr.CHUNK), np.int64)
            for key, b in zip(keys, out):
                counts[key] = b.column("n")[0].as_py()
            for side, m in enumerate((u, v)):
                values = np.rint((m @ m.T)[lower] * scale).astype(int) + scale
                assert np.array_equal(counts[side].ravel()[: 2 * scale + 1], np.bincount(values, minlength=2 * scale + 1))
