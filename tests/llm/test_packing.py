import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from logsift.llm import packing
from logsift.llm.registry import op1_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_plan(histogram, size):
    chosen = packing.plan(histogram, size)
    got = Counter()
    for config, times in chosen:
        assert times > 0 and sum(x * c for x, c in config) <= size
        for x, c in config:
            got[x] += c * times
    assert got == Counter({k: v for k, v in histogram.items() if v})
    return sum(times for _, times in chosen)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_near_the_bound(seed):
    draw = random.Random(seed)
    histogram = Counter(min(1024, int(draw.expovariate(1 / 300)) + 1) for _ in range(20_000))
    used = check_plan(histogram, 1024)
    fit = len(packing.best_fit(histogram.elements(), 1024))
    assert used <= fit * 1.001 + 1


def test_plan_is_optimal_on_hard_lengths():
    # Thirds that best fit decreasing mixes: 6 + 3 + 1, 4 + 4 + 2.
    assert check_plan({6: 100, 3: 100, 1: 100, 4: 200, 2: 100}, 10) == 200
    assert check_plan({7: 50, 3: 50}, 10) == 50
    assert check_plan({}, 10) == 0 and check_plan({10: 3}, 10) == 3 and check_plan({1: 25}, 10) == 3


@pytest.mark.parametrize("low, high, most", [(200, 500, 13_760), (182, 514, 13_620), (400, 600, 20_000)])
def test_steps_shrink_where_few_lengths_carry_all(low, high, most):
    lengths = np.random.default_rng(1).integers(low, high + 1, 40_000)
    assert check_plan(Counter(lengths.tolist()), 1024) <= most


def fewest(lengths, size):
    """The optimum, by trying every set of pieces that shares a sequence with the first one."""
    best = {0: 0}
    full = (1 << len(lengths)) - 1

    def least(left):
        if left not in best:
            first = left & -left
            others, found = left ^ first, len(lengths)
            chosen = others
            while True:
                if sum(x for i, x in enumerate(lengths) if (chosen | first) >> i & 1) <= size:
                    found = min(found, 1 + least(others ^ chosen))
                if not chosen:
                    break
                chosen = (chosen - 1) & others
            best[left] = found
        return best[left]

    return least(full)


@pytest.mark.parametrize("seed", range(12))
def test_few_pieces_take_the_fewest_sequences(seed):
    draw = random.Random(seed)
    lengths = [draw.randint(2, 17) for _ in range(9)]
    assert check_plan(Counter(lengths), 20) == fewest(lengths, 20)


def test_configurations_are_the_best():
    draw = np.random.default_rng(3)
    for size in (1, 7, 90, 400):
        lengths = np.unique(draw.integers(1, size + 1, 12))
        prices = draw.random(len(lengths)) + 0.01
        best = [0.0]
        for room in range(1, size + 1):
            best.append(max([best[-1], *(best[room - x] + p for x, p in zip(lengths, prices) if x <= room)]))
        config, price = packing.best_configuration(size, lengths, prices)
        value = dict(zip(lengths.tolist(), prices))
        assert sum(x * c for x, c in config.items()) <= size
        assert price == pytest.approx(best[size]) == sum(value[x] * c for x, c in config.items())


def test_clashing_columns_and_hot_groups(spark):
    draw = random.Random(4)
    rows = [(None, 1, draw.choice([5, 5, 16, 3]), "a", i, i, i, "s", i) for i in range(500)]
    names = "doc_id long, piece int, length long, row string, number int, salt int, rank int, sequence_id string, n int"
    packed = packing.pack(spark.createDataFrame(rows, names), size=16, ranked=10)
    assert packed.columns == ["doc_id", "piece", "length", "row", "number", "salt", "rank", "n", "sequence_id", "offset"]
    got = packed.collect()
    packed_ok(got, 16)
    assert sorted((r.length, r.row, r.number, r.salt, r.rank, r.n) for r in got) == sorted((r[2], "a", r[4], r[5], r[6], r[8]) for r in rows)


def packed_ok(rows, size):
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    at = (None, 0)
    for sequence, offset, length in places:
        assert offset == (at[1] if sequence == at[0] else 0)
        at = (sequence, offset + length)
        assert at[1] <= size


def test_rows(spark):
    texts = ["", None, "one", "one", "a b c d e f g " * 40, "word " * 7, "x y " * 3]
    df = spark.createDataFrame(
        [(None if i == 2 else i % 5, t, 1, "s") for i, t in enumerate(texts * 3)],
        "doc_id long, text string, length int, offset string",
    )
    pieces = packing.token_pieces(df, PATH, size=16, keep_ids=True)
    packed = packing.pack(pieces, size=16)
    rows = packed.collect()
    packed_ok(rows, 16)
    library = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in enumerate(texts * 3):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 16 or 16
        cuts = [0, *range(first, len(ids) + 1, 16)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[None if i % 7 == 2 and i == 2 else i % 5, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    whole = packing.sequences(packed).collect()
    by = {r.sequence_id: r.ids for r in whole}
    for r in rows:
        assert by[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == r.ids
    assert sum(len(r.members) for r in whole) == len(rows)
    assert packing.pack(packing.token_pieces(df.limit(0), PATH)).count() == 0


def test_query(spark):
    rows = op1_packing(spark, "/root/testdata/sf0.001").collect()
    packed_ok(rows, 1024)
    n = len({r.sequence_id for r in rows})
    bound = -(-sum(r.length for r in rows) // 1024)
    assert n <= bound * 1.05 + 1
