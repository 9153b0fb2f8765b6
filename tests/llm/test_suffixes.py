import random

import numpy as np
import pytest

from logsift.llm import suffixes
from logsift.llm.suffixes import Suffixes, occurs_earlier


def rows(seed, n, letters="ab", most=12):
    draw = random.Random(seed)
    parts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, most))).encode() for _ in range(n)]
    return parts, np.sort(np.array([draw.randrange(max(1, n // 7)) for _ in range(n)], dtype=np.int64))


def check_sort(parts, group):
    order, common = Suffixes(parts).sort(group)
    want = sorted(range(len(parts)), key=lambda r: (group[r], parts[r], r))
    assert order.tolist() == want
    for at in range(len(parts)):
        if at == 0 or group[order[at]] != group[order[at - 1]]:
            assert common[at] == -1
        else:
            a, b = parts[order[at - 1]], parts[order[at]]
            assert common[at] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("seed", range(8))
def test_sort(seed):
    check_sort(*rows(seed, 300, ["ab", "a", "a\0b", "abcdefgh"][seed % 4]))


def test_collisions_are_found(monkeypatch):
    """With hashes that all collide, the neighbours' bytes still give the right order."""
    made = Suffixes.__init__

    def weak(self, parts):
        made(self, parts)
        self.hashes[:] = 0

    monkeypatch.setattr(Suffixes, "__init__", weak)
    check_sort(*rows(3, 200))


@pytest.mark.parametrize("seed", range(6))
def test_windows(seed):
    draw, size = random.Random(seed), 6
    parts, group, before, rank = [], [], [], list(range(60))
    draw.shuffle(rank)
    for g in range(12):
        for _ in range(5):
            left = "".join(draw.choice("ab") for _ in range(draw.randint(0, 4)))
            right = "ab" + "".join(draw.choice("ab") for _ in range(draw.randint(size, 9) - 2))
            cut = draw.randint(0, min(len(left), size - 2)) if left else 0
            part = (left + right)[: max(size, draw.randint(len(left) + 2, len(left + right)))]
            parts.append(part.encode())
            before.append(len(left))
            group.append(g)
    group, before, rank = np.array(group), np.array(before), np.array(rank)
    got = occurs_earlier(group, rank, parts, before, size)
    for r, part in enumerate(parts):
        for d in range(got.shape[1]):
            start = before[r] - d
            if start < 0 or start + size > len(part):
                assert not got[r, d]
                continue
            window = part[start : start + size]
            want = any(
                group[o] == group[r] and rank[o] < rank[r] and before[o] >= d and before[o] - d + size <= len(parts[o])
                and parts[o][before[o] - d : before[o] - d + size] == window
                for o in range(len(parts))
            )
            assert got[r, d] == want


def test_large_group_of_copies():
    n = 20_000
    got = occurs_earlier(np.zeros(n, np.int64), np.arange(n), [b"x" * 10] * n, np.full(n, 3), 6)
    assert got.sum() == 4 * 0 + (n - 1) * sum(1 for d in range(4) if 3 - d + 6 <= 10)
    assert suffixes.occurs_earlier(np.empty(0, np.int64), np.empty(0, np.int64), [], np.empty(0, np.int64), 6).size in (0, 1)
