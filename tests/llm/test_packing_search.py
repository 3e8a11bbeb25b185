"""The search of op5 takes blocks of few and of many pieces alike."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from wordmill.llm import packing  # noqa: E402


@pytest.mark.parametrize("parts, bins", [(4, 5), (4, 7), (3, 12)])
def test_planted_packings_are_found(parts, bins):
    """Bins cut into pieces, and eight full ones: up to 32 pieces and more, all are packed into as many bins again."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        cuts = [np.sort(np.concatenate([[0, 60], rng.choice(np.arange(1, 60), parts - 1, replace=False)])) for _ in range(bins)]
        own, _ = packing.pack(np.concatenate([*(np.diff(c) for c in cuts), np.full(8, 60)]).astype(np.int64), 60)
        assert own.max() + 1 == bins + 8


def test_fillings_are_all_maximal_ones():
    rng = np.random.default_rng(4)
    for _ in range(200):
        room, pieces = int(rng.integers(1, 25)), rng.integers(1, 15, int(rng.integers(0, 9))).tolist()
        want = set()
        for bits in range(1 << len(pieces)):
            taken = [p for k, p in enumerate(pieces) if bits >> k & 1]
            left = [p for k, p in enumerate(pieces) if not bits >> k & 1]
            if sum(taken) <= room and all(sum(taken) + p > room for p in left):
                want.add(tuple(sorted(taken)))
        got = [tuple(sorted(f)) for f in packing.fillings(np.bincount(np.array(pieces, np.int64), minlength=26), room, room)]
        assert len(got) == len(set(got)) and set(got) == want
        assert [sum(f) for f in got] == sorted(map(sum, got), reverse=True)
