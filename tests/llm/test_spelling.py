import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import oracle
import pytest

from logsift.llm import spelling
from logsift.llm.registry import SQL, op11_spelling

LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, word string, n int, id string"


def brute_words(rows):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(words):
    form = {}
    for w in words:
        others = sorted((-words[v], v) for v in words if near(w, v))
        best = others[0][1] if others and -others[0][0] >= 5 * words[w] else None
        form[w] = best, len(others)
    out = []
    for w, n in words.items():
        root = w
        while form[root][0]:
            root = form[root][0]
        f, count = form[w]
        out.append((w, f, root, n, count, words.get(f)))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    found = spelling.variants(spelling.words(df))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def near_words(draw, count):
    """Words over few letters, many of them one code point apart, with counts of all sizes."""
    words = ["".join(draw.choices("abéÿ", k=draw.randint(5, 8))) for _ in range(count)]
    return [w for w in words for _ in range(draw.choice([1, 3, 5, 5, 6, 26, 30, 160]))]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    draw = random.Random(seed)
    flat = near_words(draw, 150)
    draw.shuffle(flat)
    rows = [(draw.choice([None, i, -i]), draw.choice([" ", "1", "\n", "·"]).join(w.upper() if draw.random() < 0.1 and w.isascii() else w for w in flat[i::40])) for i in range(40)]
    assert run(spark, rows) == brute(brute_words(rows))


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (None, None), (3, " 12 × ÷ "), (4, "ÀÉÎÕÜß " * 5), (5, "ABCDEF abcdef Abcdef aBCDEF abcdeF"), (5, "abcdeg " * 30), (5, "abcdeg " * 30)]
    got = run(spark, rows)
    assert got == brute(brute_words(rows))
    assert ("ÀÉÎÕÜß", None, "ÀÉÎÕÜß", 5, 0, None) in got
    assert run(spark, rows[:3]) == run(spark, []) == []


def test_very_long_words_and_chains(spark):
    long = "ab" * 20_000
    rows = [(i, f"{long} {long}c {'x' * 30_000} {'x' * 29_999}") for i in range(6)]
    rows += [(9, " ".join(["chains"] * 5 + ["chain" + "st"] * 25 + ["chainest"] * 130 + ["chainesst"] * 700))]
    got = run(spark, rows)
    words = {r[0]: r for r in got}
    assert got == brute(brute_words(rows))
    assert words["chains"][2] == words["chainst"][2] == "chainesst" and words[long][4] == 1


def test_deleted_code_points(spark):
    rows = [(i, "deleteme somewhere") for i in range(3000)]
    got = run(spark, rows)
    assert got == brute(brute_words(rows)) and len(got) > 2


def test_nodes_are_prefixes(spark):
    draw = random.Random(5)
    words = sorted({"".join(draw.choices("ab", k=draw.randint(1, 9))) for _ in range(400)} | {"ab" * 50})
    conf = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(w, len(w)) for w in words], "key string, given long")
        rows = spelling.numbered(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", conf)
    node = {}
    for r in rows:
        assert r.given == len(r.key) and len(r.nodes) == len(r.key) + 1
        for i, x in enumerate(r.nodes):
            assert node.setdefault(r.key[:i], x) == x
    assert len(set(node.values())) == len(node) and sorted(r.key for r in rows) == words
    ends = [node[w] for w in words]
    assert ends == sorted(ends)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    assert oracle.compare(op11_spelling(spark, folder), oracle.connect(folder), SQL["op11_spelling"]) is None
