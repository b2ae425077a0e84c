"""Block building of the Jaccard join against a plain version, at any batch cut and block size."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lamella.llm import jaccard_join


@pytest.mark.parametrize("large", [3, 5, 1 << 14])
def test_shared_blocks(monkeypatch, large):
    monkeypatch.setattr(jaccard_join, "LARGE", large)
    for seed in range(200):
        r = random.Random(seed)
        rows = sorted((r.randint(-3, 6) if r.random() < 0.8 else r.randint(100, 150), r.randint(0, 9)) for _ in range(r.randint(0, 80)))
        batches, at = [], 0
        while at < len(rows):
            part = rows[at : (at := at + r.randint(0, 7))]
            batches.append(pa.RecordBatch.from_arrays([pa.array([x[i] for x in part], pa.int64()) for i in (0, 1)], ["h", "digest"]))
        got = sorted(x for b in jaccard_join._shared_blocks(batches) for x in zip(*[c.to_pylist() for c in b.columns]))
        blocks: dict = {}
        for h, d in rows:
            blocks.setdefault(h, set()).add(d)
        assert got == sorted((h, d, min(s), min(len(s), large)) for h, s in blocks.items() if len(s) > 1 for d in s)


def test_small_blocks_need_no_trees(monkeypatch):
    draw, blocks = np.random.default_rng(5), []
    for _ in range(300):
        base = draw.integers(0, 1 << 60, draw.choice([3, 60, 250, 270, 520, 1000]), dtype=np.uint64)
        sets = [np.unique(np.where(draw.random(len(base)) < draw.choice([0.02, 0.1, 0.5]), draw.integers(0, 1 << 60, len(base), dtype=np.uint64), base))[: len(base) - draw.integers(0, 3)] for _ in range(draw.integers(2, 14))]
        blocks.append([(i, len(x), jaccard_join.bitmap(x, jaccard_join.BITS << jaccard_join.level_of(len(x))).tobytes(), i - i % 2 * draw.integers(0, 2)) for i, x in enumerate(sets)])

    def groups():
        out = []
        for rows in blocks:
            forest, comp = jaccard_join.Forest(), {r[0]: r[3] for r in rows}
            for a, b in jaccard_join._plausible_forest(True, rows, rows):
                forest.join(comp[a], comp[b])
            roots = [forest.root(r[3]) for r in rows]
            out.append([roots.index(x) for x in roots])
        return out

    few = jaccard_join.FEW
    monkeypatch.setattr(jaccard_join, "FEW", 0)
    want = groups()
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "Tree", None)
    assert groups() == want and len({max(x) for x in want}) > 3
