"""Hash-compared suffix sort: which strings around anchors occur earlier.

A row is a stretch of bytes with an anchor in it and stands for all windows of ``size`` bytes in the stretch. Rows of a
group have the bytes at their anchors in common. A window of a row occurs in another row of the group if they agree
far enough to the right and to the left of their anchors. So the right parts are sorted as suffixes, and the
left parts read backwards, by mergesort. Two suffixes are compared by binary search for their common extension, on
prefix polynomial hashes modulo 2 ** 64, and the byte behind it. In the end every two neighbours are compared byte by
byte: common extensions and order must be as the hashes said, or the group is sorted again by its bytes. As sorted
neighbours prove the whole order, no result rests on a hash.
"""

from __future__ import annotations

import numpy as np

from logsift.llm.shingles import powers


class Suffixes:
    """Byte strings as padded rows, with the hashes of all their prefixes."""

    def __init__(self, parts: list[bytes]):
        self.length = np.fromiter(map(len, parts), np.int64, len(parts))
        width = int(self.length.max(initial=0))
        self.bytes = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)
        self.hashes = np.zeros((len(parts), width + 1), np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * powers(1 << 16)[0][:width], axis=1, out=self.hashes[:, 1:])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of rows i and j, by binary search on the hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.length[i], self.length[j])
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = self.hashes[i, middle] == self.hashes[j, middle]
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)
        return low

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self._less_after(i, j, self.common(i, j))

    def _less_after(self, i: np.ndarray, j: np.ndarray, common: np.ndarray) -> np.ndarray:
        at = np.minimum(common, max(0, self.bytes.shape[1] - 1))
        ended, other = common == self.length[i], common == self.length[j]
        if not self.bytes.shape[1]:
            return np.zeros(len(i), bool)
        return ~other & (ended | (self.bytes[i, at] < self.bytes[j, at]))

    def sort(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows in order within their groups (rows of a group are adjacent), and what each has in common with
        the row before it; -1 for the first of a group."""
        order = self._merge_sort(group)
        before, after = order[:-1], order[1:]
        inside = group[before] == group[after]
        common = np.where(inside, self.common(before, after), -1)
        wrong = np.flatnonzero(inside & ~self._proved(before, after, common))
        for g in np.unique(group[after[wrong]]):
            low, high = np.searchsorted(group, [g, g + 1])
            rows = sorted(range(low, high), key=lambda r: self.bytes[r, : self.length[r]].tobytes())
            order[low:high] = rows
            for place in range(low, high - 1):
                common[place] = self._exactly(np.array([rows[place - low]]), np.array([rows[place - low + 1]]))[0]
        return order, np.concatenate([[-1], common])[: len(order)]

    def _exactly(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extension, byte by byte."""
        width = self.bytes.shape[1]
        differ = self.bytes[i] != self.bytes[j]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1) if width else 0, width)
        return np.minimum(first, np.minimum(self.length[i], self.length[j]))

    def _proved(self, i: np.ndarray, j: np.ndarray, common: np.ndarray) -> np.ndarray:
        return (self._exactly(i, j) == common) & ~self._less_after(j, i, np.maximum(common, 0))

    def _merge_sort(self, group: np.ndarray) -> np.ndarray:
        """All groups at once, from runs of one row upwards: a row's place is its rank in both runs."""
        order = np.arange(len(group))
        _, first, sizes = np.unique(group, return_index=True, return_counts=True)
        first, end = np.repeat(first, sizes), np.repeat(first + sizes, sizes)
        width = 1
        while width < sizes.max(initial=0):
            run = (np.arange(len(order)) - first) // width
            mate = first + (run ^ 1) * width
            slots = np.flatnonzero(mate < end)
            mate, left = mate[slots], run[slots] % 2 == 0
            size = np.minimum(width, end[slots] - mate)
            rows = order[slots]
            low, high = np.zeros(len(slots), np.int64), size.copy()
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) // 2
                mine, theirs, is_left = rows[open_], order[mate[open_] + middle], left[open_]
                # Rows that are equal keep their order: the left run's come first.
                smaller = self.less(np.where(is_left, theirs, mine), np.where(is_left, mine, theirs))
                forward = np.where(is_left, smaller, ~smaller)
                low[open_] = np.where(forward, middle + 1, low[open_])
                high[open_] = np.where(forward, high[open_], middle)
            own = (slots - first[slots]) % width
            start = first[slots] + (run[slots] // 2) * 2 * width
            merged = order.copy()
            merged[start + own + low] = rows
            order, width = merged, width * 2
        return order


def occurs_earlier(group: np.ndarray, rank: np.ndarray, parts: list[bytes], before: np.ndarray, size: int) -> np.ndarray:
    """Per row and window of it, in order of their starts, whether the window occurs in a row of smaller rank.

    ``before``: bytes of the row before its anchor. Rows of a group are adjacent. The result has a column for every
    distance of a window's start from the anchor, from 0 up; columns that a row has no window for are False.
    """
    count = len(parts)
    length = np.fromiter(map(len, parts), np.int64, count)
    least = before - (length - size)  # nearest start of a window, before the anchor
    out = np.zeros((count, int(before.max(initial=0)) + 1), bool)
    if not count:
        return out
    # Rows that are equal throughout: the first stands for all.
    seen: dict[tuple, int] = {}
    head = np.empty(count, np.int64)
    for row in np.argsort(rank, kind="stable"):
        head[row] = seen.setdefault((group[row], before[row], parts[row]), row)
    distance = np.arange(out.shape[1])
    has = (distance >= least[:, None]) & (distance <= before[:, None])
    out |= has & (head != np.arange(count))[:, None]

    heads = np.flatnonzero(head == np.arange(count))
    _, sizes = np.unique(group[heads], return_counts=True)
    heads = heads[np.repeat(sizes, sizes) > 1]
    if not len(heads):
        return out
    own, groups = rank[heads], group[heads]
    sides = []
    for side in (
        [parts[r][before[r] :] for r in heads],
        [parts[r][: before[r]][::-1] for r in heads],
    ):
        sides.append(Suffixes(side).sort(groups))
    place = [np.empty(len(heads), np.int64) for _ in sides]
    for p, (order, _) in zip(place, sides, strict=True):
        p[order] = np.arange(len(heads))
    for d in range(out.shape[1]):
        active = np.flatnonzero(has[heads, d])
        if len(active) < 2:
            continue
        # Rows agree on the window if they agree on d bytes to the left and the rest to the right.
        right, left = (np.cumsum(common < need) for (_, common), need in zip(sides, (size - d, d), strict=True))
        same = right[place[0][active]] * (len(heads) + 1) + left[place[1][active]]
        order = np.lexsort((own[active], same))
        again = np.concatenate([[False], same[order][1:] == same[order][:-1]])
        out[heads[active[order[again]]], d] = True
    return out
