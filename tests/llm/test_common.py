import random

import pyarrow as pa
import pytest

from logsift.llm import common


def brute(links):
    part = {}

    def root(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x

    for a, b in links:
        if a != b:
            part[max(root(a), root(b))] = min(root(a), root(b))
    return sorted((x, root(x)) for x in part)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    draw = random.Random(seed)
    links = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(180)]
    links += [(1000 + i, 1001 + i) for i in range(40)]  # a chain
    links += [(2000, 2000 + i) for i in range(1, 50)] + links[:20]  # a star, and links twice
    df = spark.createDataFrame(links, "x long, y long")
    assert sorted(map(tuple, common.components(df, "x", "y").collect())) == brute(links)


def test_components_of_nothing(spark):
    df = spark.createDataFrame([(1, 1)], "x long, y long")
    assert common.components(df, "x", "y").count() == 0
    assert common.components(df.limit(0), "x", "y").count() == 0


def test_groups_over_batches():
    batches = [pa.record_batch({"a": [1, 1, 2]}), pa.record_batch({"a": pa.array([], pa.int64())}), pa.record_batch({"a": [2, 3]}), pa.record_batch({"a": [3, 3]})]
    assert [g["a"].to_pylist() for g in common.groups(iter(batches), ["a"])] == [[1, 1], [2, 2], [3, 3, 3]]


def test_blocks_let_every_pair_meet_once(spark):
    rows = spark.createDataFrame([(g, i) for g, n in ((1, 1), (2, 2), (3, 50)) for i in range(n)], "g int, node long")
    cells = {}
    for r in common.in_blocks(rows, ["g"], "node", 8).collect():
        cells.setdefault((r.g, r.i, r.j), []).append((r.node, r.block))
    pairs = []
    for (g, i, j), members in cells.items():
        pairs += [(g, *sorted((a, b))) for n, (a, x) in enumerate(members) for b, y in members[:n] if (i == j) or x != y]
    assert len(pairs) == len(set(pairs)) == 1 + 50 * 49 // 2
