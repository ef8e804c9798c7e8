"""The coder's tables of slots against counting, and their size."""

import numpy as np
import pytest

from marginalia.llm.rangecoder import CHUNK, EACH, Frequencies, _slots, decode_container, encode_container


@pytest.mark.parametrize("largest", [1, 64, 65, 700, 1024, 1025, 4096])
def test_slots_are_what_counting_gives(largest):
    rng = np.random.default_rng(largest)
    lanes, steps = 5, 300
    seen, slots = Frequencies(lanes, largest), np.ones((lanes, largest), np.int64)
    for t in range(steps):
        n = lanes if t < 200 else 3  # lanes that end drop out
        ids = np.minimum(rng.zipf(1.2, n), largest) - 1 if t % 2 else rng.integers(0, largest, n)
        starts = np.cumsum(slots, axis=1) - slots
        start, own = seen.of(ids)
        assert start.tolist() == starts[range(n), ids].tolist() and own.tolist() == slots[range(n), ids].tolist()
        for v in (starts[range(n), ids], starts[range(n), ids] + own - 1, rng.integers(0, slots[:n].sum(axis=1))):
            found, inside = seen.find(v.astype(np.float64))
            want = [int(np.searchsorted(starts[i], v[i], side="right")) - 1 for i in range(n)]
            assert found.tolist() == want and inside.tolist() == (v - starts[range(n), want]).tolist()
        seen.add(ids)
        slots[range(n), ids] += EACH


def test_tables_are_as_narrow_as_the_alphabets():
    def size(largest):
        f = Frequencies(8, largest)
        return f.high.nbytes + f.low.nbytes + f.own.nbytes

    assert 3 * size(700) < size(4096) and 3 * size(200) < size(700)  # once all were as wide as the largest block


def test_slots_counted_ahead_are_those_of_the_tables():
    rng = np.random.default_rng(3)
    for n, sizes in ((1, [1, 1]), (CHUNK, [5, 64]), (3 * CHUNK + 7, [1, 700, 30])):
        syms = np.stack([np.minimum(rng.zipf(1.2, n), k) - 1 for k in sizes]).astype(np.uint16)
        start, own = _slots(syms, sizes)
        tables = Frequencies(len(sizes), max(sizes))
        for t in range(n):
            ids = syms[:, t].astype(np.int64)
            assert [start[:, t].tolist(), own[:, t].tolist()] == [x.tolist() for x in tables.of(ids)]
            tables.add(ids)


def test_encoding_asks_no_tables(monkeypatch):
    docs = [(1, (np.random.default_rng(5).zipf(1.3, 9000) % 70000).astype(np.uint32))]
    want = encode_container(docs)
    monkeypatch.setattr(Frequencies, "add", lambda *_: 1 / 0)
    assert encode_container(docs) == want  # what lies below an id is counted ahead, not kept for each step


def test_decoding_asks_only_where_predicted_ids_start(monkeypatch):
    docs = [(1, (np.random.default_rng(5).zipf(1.3, 9000) % 70000).astype(np.uint32)), (2, np.arange(5000, dtype=np.uint32) % 7)]
    raw = encode_container(docs)
    monkeypatch.setattr(Frequencies, "of", lambda *_: 1 / 0)
    assert [(d, ids.tolist()) for d, ids in decode_container(raw)] == [(d, ids.tolist()) for d, ids in docs]
