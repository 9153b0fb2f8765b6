import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from logsift.llm import quality
from logsift.llm.registry import op2_quality

FOLDER = "/root/testdata/sf0.01"


def test_features_are_finite():
    for text in ["", " ", "\n\n", "a", "!!!", "é" * 10, "x" * 1_000_000, "\x00", "a " * 50_000, "\ud800"]:
        row = quality.features(text)
        assert row.shape == (quality.WIDTH,) and np.isfinite(row).all() and (row >= 0).all() and (row <= 1.001).all()


def test_prior_and_risk():
    draw = np.random.default_rng(0)
    good, bad = draw.normal(0, 1, (4000, 3)), draw.normal([4, 0, 0], 1, (1500, 3))
    unlabelled = np.concatenate([good[2000:], bad[:500]])
    model = quality.train(good[:2000], unlabelled, np.zeros(3), np.ones(3))
    assert 0.72 < model.prior < 0.88
    assert (model.score(draw.normal(0, 1, (1000, 3))) >= 0.5).mean() > 0.93
    assert (model.score(bad[500:]) < 0.5).mean() > 0.9


def test_prior_against_brute_force():
    draw = np.random.default_rng(5)
    for share in (0.1, 0.5, 0.9):
        positive = draw.normal(1, 1, 300)
        unlabelled = np.where(draw.random(400) < share, draw.normal(1, 1, 400), draw.normal(-2, 1, 400))
        margin = np.sqrt(np.log(40) / 800) + np.sqrt(np.log(40) / 600)
        found = []
        for cut in sorted({np.quantile(positive, i / 200) for i in range(101)}):
            p = sum(x >= cut for x in positive) / 300
            u = sum(x >= cut for x in unlabelled) / 400
            found.append(((u + margin) / p, (u + 2 * (u * (1 - u) / 400) ** 0.5) / p))
        want = min(0.98, max(0.02, min(found)[1]))
        assert abs(quality.class_prior(positive, unlabelled) - want) < 1e-9


def test_descent_lowers_the_risk():
    """The non-negative unbiased risk, row by row, of the fitted network against others: no output and no fit."""
    draw = np.random.default_rng(6)
    positive, prior = draw.normal(2, 1, (200, 2)), 0.5
    unlabelled = np.concatenate([draw.normal(2, 1, (200, 2)), draw.normal(-2, 1, (200, 2))])

    def risk(layers):
        def mean(rows, sign):
            return sum(1 / (1 + np.exp(sign * quality.forward(layers, x[None])[1][0])) for x in rows) / len(rows)

        return prior * mean(positive, 1) + max(0.0, mean(unlabelled, -1) - prior * mean(positive, -1))

    layers = quality.descend(positive, unlabelled, prior)
    constant = [*layers[:2], layers[2] * 0, layers[3] * 0]
    assert risk(layers) < 0.1 < risk(constant) and risk(layers) < risk([*layers[:2], -layers[2], layers[3]])


def test_held_out_accuracy(spark):
    rows = op2_quality(spark, FOLDER)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality")
    data = rows.join(labels, "doc_id", "left").collect()
    assert len(data) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for r in data:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    tested = [r for r in data if r.held_out and r.quality is not None]
    assert sum(r.predicted == r.quality for r in tested) / len(tested) > 0.9
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in tested if a.quality == 1 for b in tested if b.quality == 0]
    assert sum(pairs) / len(pairs) > 0.98


def test_labels_of_held_out_rows_change_nothing(spark):
    draw = random.Random(1)
    docs = spark.createDataFrame(
        [(i, " ".join(draw.choice(["fine", "words", "here", "and", "there"]) for _ in range(30)) if i % 4 else "BAD!! " * 20, 5) for i in range(400)],
        "doc_id long, text string, label int",
    )
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 1) for i in range(0, 400, 2)], "doc_id long, quality int, text int")
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    first = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    second = {r.doc_id: r.score for r in quality.classify(docs, turned).collect()}
    assert first == second
    assert sum((first[i] >= 0.5) == (i % 4 > 0) for i in first) > 360


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "text"), (2, "x" * 100_000), (2, "x" * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, None), (2, None)], "doc_id long, quality int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 5 and {r.score for r in rows} == {0.5}
    assert quality.classify(docs.limit(0), labels.limit(0)).count() == 0
    model = quality.fit(quality.featured(docs), labels)
    assert quality.keep_good(docs.withColumn("score", F.lit(1)), model).count() == 5
