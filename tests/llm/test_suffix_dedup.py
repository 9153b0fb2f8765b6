import hashlib
import random

import numpy as np
import pytest

from logsift.llm import suffix_dedup as dedup
from logsift.llm.registry import op6_suffix_dedup


def brute(rows, size):
    """(key, bytes, removed, runs, kept) by looking at every window; rows in the order of id, then digest."""
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is not None, rows[r][0] or 0, hashlib.sha256((rows[r][1] or "").encode()).digest()))
    seen, out = set(), []
    for r in order:
        data = (rows[r][1] or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - size + 1):
            window = data[p : p + size]
            if window in seen:
                gone[p : p + size] = True
            seen.add(window)
        edges = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
        kept = bytes(np.frombuffer(data, np.uint8)[~gone[:-1]])
        out.append((rows[r][0], len(data), int(gone.sum()), int((edges == 1).sum()), kept))
    return sorted(out, key=repr)


def run(spark, rows, **settings):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, spans string")
    found = dedup.dedup(df, s=dedup.Settings(**settings)).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found), key=repr)


def corpus(seed, n=60, unit=1):
    draw = random.Random(seed)
    letters = ["a", "b", " ", "é", "xyz", "字"]
    make = lambda k: "".join(draw.choice(letters) for _ in range(k))
    passages = [make(draw.randint(5, 60) * unit) for _ in range(6)]
    rows = []
    for i in range(n):
        text = "".join(draw.choice([make(draw.randint(0, 40) * unit), draw.choice(passages)]) for _ in range(draw.randint(0, 6)))
        if draw.random() < 0.2 and rows:
            text = draw.choice(rows)[1]
        if draw.random() < 0.2 and text:
            at = draw.randrange(len(text))
            text = text[:at] + make(2) + text[at + 1 :]
        rows.append((draw.randint(0, n), text))
    return rows


ODD = [(None, "q" * 300), (None, None), (-3, ""), (7, "ab" * 150), (7, "ab" * 150), (8, "é" * 120), (9, "z" * 99), (10, "z" * 99), (11, "z" * 100)]


@pytest.mark.parametrize("seed, size, gram, hot", [(1, 10, 4, 20_000), (2, 10, 4, 3), (3, 12, 5, 0)])
def test_against_brute_force(spark, seed, size, gram, hot):
    rows = corpus(seed) + ODD
    got = run(spark, rows, size=size, gram=gram, hot=hot, chunk_bits=2, sort_rows=50, segment=128, long_text=1000)
    assert got == brute(rows, size)


def test_at_full_size(spark):
    rows = corpus(5, 40, 8) + ODD + [(50, "word " * 400), (51, "other words " * 300 + "word " * 100)]
    assert run(spark, rows) == brute(rows, 100)


def test_empty(spark):
    assert run(spark, []) == []


def test_anchors_cover_every_window():
    draw = np.random.default_rng(1)
    texts = [bytes(draw.integers(97, 99, n).astype(np.uint8)) for n in (0, 99, 100, 101, 500, 3000)]
    data, ends = dedup.laid_out(texts)
    anchor, low, high, _ = dedup.anchors(data, ends)
    covered = sorted(p for a, b in zip(low, high) for p in range(a, b + 1))
    begin = np.concatenate([[0], ends[:-1]])
    assert covered == [p for a, b in zip(begin, ends) for p in range(a, b - 99)]
    assert ((low <= anchor) & (anchor + dedup.DEFAULT.gram <= low + 100) & (high <= anchor)).all()


def test_texts_are_cut(spark):
    passage = "A passage of more than one hundred bytes that two documents have, word for word, from first to last one. é"
    df = spark.createDataFrame([(1, f"x{passage}y", "en", 3), (2, f"1{passage}2", "de", 4), (3, None, None, None), (4, "clean", "en", 5)], "doc_id long, text string, data string, n_chars long")
    got = {r.doc_id: (r.text, r.data, r.n_chars) for r in dedup.without_repeats(df).collect()}
    assert got == {1: (f"x{passage}y", "en", 3), 2: ("12", "de", 4), 3: (None, None, None), 4: ("clean", "en", 5)}


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in op6_suffix_dedup(spark, folder).collect()), key=repr)
    assert got == sorted(((k, n, m, s, hashlib.sha256(b).hexdigest()) for k, n, m, s, b in brute(rows, 100)), key=repr)
