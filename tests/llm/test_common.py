import random
import tracemalloc

import numpy as np
import pyarrow as pa

from phasegrid.llm import common as C


def one_by_one(data, starts, ends):
    with np.errstate(over="ignore"):
        return np.concatenate([
            C.mix(np.sum(C.BYTE_HASH[data[a:b]] * C.powers(b - a), keepdims=True, dtype=np.uint64) + np.uint64(b - a) * C.BASE)
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True)
        ])


def test_span_hashes_need_little_memory_and_stay_the_same(monkeypatch):
    data = np.random.default_rng(1).integers(97, 123, 4 << 20).astype(np.uint8)
    starts = np.arange(0, len(data), 8)
    ends = np.minimum(starts + 7, len(data))
    tracemalloc.start()
    found = C.span_hashes(data, starts, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * len(data)  # all spans at once: over 30 times
    assert (found[:500] == one_by_one(data, starts[:500], ends[:500])).all()
    monkeypatch.setattr(C, "SPAN_BYTES", 20)  # spans longer than a part, and parts that end between spans
    cuts = np.sort(np.random.default_rng(2).choice(5000, 400, replace=False))
    a, b = cuts[:-1], cuts[1:]
    assert (C.span_hashes(data, a, b) == one_by_one(data, a, b)).all()


def test_slices_hold_all_rows_with_nulls():
    rng = random.Random(4)
    rows = [rng.choice([None, "", "x" * rng.randint(1, 90), "äß"]) for _ in range(300)]
    for column in (pa.array(rows), pa.array(rows).slice(7, 250), pa.array([None, None], pa.string())):
        got = [
            bytes(data[a:b])
            for _, _, data, off in C.text_slices(column, 100)
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)
        ]
        assert got == [(x or "").encode() for x in column.to_pylist()]


def test_tidy_passes_all_batches_and_gives_memory_back():
    pool = pa.default_memory_pool()
    batches = [pa.record_batch([pa.array([b"x" * 1000] * 1000)], ["a"]) for _ in range(3)]
    assert [b.num_rows for b in C.tidy(lambda rows: (b.slice(1) for b in rows))(iter(batches))] == [999] * 3
    assert pool.bytes_allocated() >= 0
