import random
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import numpy as np
import oracle
import pytest

from logsift.llm import jaccard
from logsift.llm.registry import SQL, op7_jaccard


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def set_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [set_of(t) for _, t in rows]
    part = list(range(len(rows)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                part[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    return sorted(((key, len(sets[i]), least.get(root(i), key)) for i, (key, _) in enumerate(rows)), key=repr)


def corpus(seed, n=150):
    draw = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(400)]
    passage = [draw.choice(vocabulary) for _ in range(60)]
    bases = [[draw.choice(vocabulary) for _ in range(draw.choice([3, 5, 6, 9, 20, 60, 200]))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(draw.choice(bases))
        kind = draw.random()
        if kind < 0.3:
            words = [draw.choice(vocabulary) for _ in range(draw.choice([4, 5, 12, 80]))]
        for _ in range(draw.choice([0, 0, 1, 2, 4])):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        if draw.random() < 0.4:
            at = draw.randrange(len(words))
            words[at:at] = passage
        rows.append((n - i, draw.choice([" ", "\n", "  "]).join(words)))
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n int, same string")
    return sorted((tuple(r) for r in jaccard.join(df).collect()), key=repr)


@pytest.mark.parametrize("seed, sizes", [(1, {}), (2, {"BLOCK": 5, "LEAF": 2, "FAN": 2}), (3, {"STARS": 0})])
def test_against_brute_force(spark, monkeypatch, seed, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus(seed)
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (None, "one"), (905, "a b c d e f g h"), (905, "a b c d e f g h"), (906, "é b c d e\x0bf g h"), (None, "lone words"), (907, "zz " * 20_000)]
    assert run(spark, rows) == brute(rows)


def test_null_ids_link_different_texts(spark):
    """Near copies among rows with a null id, one of a row with an id, and one that bridges two rows with ids."""
    words = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    bridge = [f"u{i}" for i in range(60)]
    rows = [(None, " ".join(words)), (None, " ".join([*words, "x"])), (None, " ".join([*words, "x"]))]
    rows += [(7, " ".join(other)), (None, " ".join([*other, "x"]))]
    rows += [(3, " ".join(bridge)), (None, " ".join(bridge[7:])), (2, " ".join(bridge[14:]))]
    got = run(spark, rows)
    assert got == brute(rows)
    assert (2, 42, 2) in got and (3, 56, 2) in got and (None, 57, 7) in got
    kept = [r[0] for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept, key=str) == [2, 7, None]


def test_threshold_is_exact(spark):
    """Sets of 7 and 7 with 6 in common link (6 / 8), of 8 and 7 with 6 in common do not."""
    base = "a b c d e f g h i j k".split()
    rows = [(1, " ".join(base)), (2, " ".join([*base[:10], "x"])), (3, " ".join([*base[:10], "y", "z"]))]
    got = dict((a, c) for a, _, c in run(spark, rows))
    assert [got[i] for i in (1, 2, 3)] == [c for _, _, c in brute(rows)]
    assert len(set(got.values())) == 2


def test_bound_never_rules_out_a_link():
    draw = np.random.default_rng(4)
    rows, sets = [], []
    for _ in range(300):
        if sets and draw.random() < 0.6:
            old = sets[draw.integers(len(sets))]
            keep = old[draw.random(len(old)) < 0.9]
            new = np.unique(np.concatenate([keep, draw.integers(0, 1 << 63, max(1, len(old) // 12)).astype(np.uint64)]))
        else:
            new = np.unique(draw.integers(0, 1 << 63, draw.integers(1, 300)).astype(np.uint64))
        sets.append(new)
    sets.sort(key=len)
    size = np.array([len(s) for s in sets])
    tree = jaccard.Tree(size, np.arange(300), jaccard.folded([jaccard.bitmap(s) for s in sets]))
    for x, y in tree.pairs():
        rows += zip(x.tolist(), y.tolist(), strict=True)
    assert len(rows) == len(set(rows))
    for i in range(300):
        for j in range(i + 1, 300):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 75 * (size[i] + size[j] - common):
                assert (i, j) in set(rows) or size[i] == 0


def test_empty(spark):
    assert run(spark, []) == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    assert oracle.compare(op7_jaccard(spark, folder), oracle.connect(folder), SQL["op7_jaccard"]) is None


def test_columns_of_the_user_stay(spark):
    names = "_id _none _own _copies id none own copies part row".split()
    rows = [(i, t, *(f"{c}{i}" for c in names)) for i, t in [(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (5, ""), (None, "x y"), (None, "x y")]]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names)))
    assert kept.columns == ["doc_id", "text", *names]
    got = sorted((r[:2] for r in kept.collect()), key=repr)
    assert got == [(1, "a b c d e f"), (5, ""), (None, "x y")]
    assert all(r[2:] == tuple(f"{c}{r[0]}" for c in names) for r in kept.collect())
