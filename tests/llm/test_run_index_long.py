"""A text longer than a part has the blocks that it has in one piece."""

import numpy as np

from dunlin.llm import run_index


def test_blocks_do_not_depend_on_the_parts(monkeypatch):
    rng = np.random.default_rng(3)
    for _ in range(60):
        rows = [rng.integers(97, 97 + rng.integers(1, 27), rng.integers(0, 900)).astype(np.uint8) for _ in range(3)]
        data, off = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        whole = run_index.blocks(data, off)
        with monkeypatch.context() as m:
            m.setattr(run_index, "PART", int(rng.integers(100, 400)))
            parts = run_index.blocks(data, off)
        assert all(np.array_equal(x, y) for x, y in zip(whole, parts))


def test_a_text_of_more_than_64_mb():
    data = np.random.default_rng(4).integers(97, 123, 65 << 20).astype(np.uint8)
    row, s0, s1, anchor, content = run_index.blocks(data, np.array([0, len(data)]))
    assert s0[0] == 0 and s1[-1] == len(data) - run_index.LEAST and np.array_equal(s0[1:], s1[:-1] + 1) and not row.any()
    tail = run_index.blocks(data[-100000:], np.array([0, 100000]))
    assert np.array_equal(tail[4][-1000:], content[-1000:]) and np.array_equal(tail[3][-1000:], anchor[-1000:])
