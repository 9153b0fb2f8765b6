"""Quality classifier by positive-unlabelled learning.

Trusted positives are the texts that the labels call good; unlabelled are all texts, whatever their label. A small
network on style features of the whole text minimises the non-negative unbiased risk

    prior * R(positives as +) + max(0, R(unlabelled as -) - prior * R(positives as -))

with the sigmoid loss; when the second part falls below zero, the step goes the other way. The share of positives
among the unlabelled, the class prior, is estimated first: a classifier of positives against unlabelled orders the
texts, and the prior is at most the least ratio of unlabelled to positive texts above any of its scores, with a margin
for chance, on rows it was not fitted on. Classifiers fitted with that prior then give closer bounds.

Fitted on at most ``SAMPLE`` positives and as many unlabelled texts, drawn by a hash of their id. The means and
deviations of the features are over all texts. Labels only say which texts are positives: label,
language, source and id are no inputs. Null texts are empty; empty texts have all features zero and get a score like
any other. Ids that are null or have several labels count as positives if all of these are 1. Without any positive text the
score is 0.5 for every text, and none is rejected.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import map_batches, shared, texts

#: Share of the unlabelled texts by which the estimated prior may be wrong, besides chance.
DOUBT = 0.04
SAMPLE, SEED, HIDDEN, EPOCHS, STEPS, BATCH, PRIOR_ROUNDS = 20_000, 11, 16, 20, 1000, 512, 1

CLASSES = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "digit": "0123456789",
    "blank": " \t",
    "line": "\n\r",
    "stop": ".,;:",
    "mark": "!?",
    "bar": "|",
    "sign": "#$%&*@^~+=<>\\/_`",
    "pair": "()[]{}\"'-",
}


@functools.cache
def class_table() -> np.ndarray:
    """Byte to class, as rows to multiply a byte histogram with."""
    table = np.zeros((256, len(CLASSES) + 2))
    for place, members in enumerate(CLASSES.values()):
        table[[ord(c) for c in members], place] = 1
    table[128:, -2] = 1
    table[table.sum(axis=1) == 0, -1] = 1  # control and other characters
    return table


WIDTH = len(CLASSES) + 2 + 11


def features(text: str) -> np.ndarray:
    """Style of a whole text: shares of character classes, words and lines; roots stretch small shares."""
    if not text:
        return np.zeros(WIDTH)
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    shares = np.bincount(data, minlength=256) @ class_table() / len(data)
    signs = (data[1:] == data[:-1]) & ((data[1:] < 48) & (data[1:] > 32) | (data[1:] == 124))
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    n = max(1, len(words))
    again = sum(map(str.__eq__, words[1:], words[:-1]))
    counts: dict[str, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    letters = shares[0] + shares[1]
    rest = [
        shares[0] / letters if letters else 0,
        np.count_nonzero(signs) / len(data),
        again / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(map(str.isupper, words)) / n,
        sum(map(str.isalpha, words)) / n,
        np.exp(-len(words) / 50),
        min(1, len(text) / n / 30),
        min(1, len(lines) / n),
    ]
    return np.sqrt(np.concatenate([shares, rest]))


def feature_rows(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.array([features(t) for t in texts(batch[column])]).reshape(-1, WIDTH)


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are not learned from."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(rows), 0.5)
        return sigmoid(forward(self.layers, self.scaled(rows))[1])

    def scaled(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.spread, -8, 8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, d = layers
    hidden = np.tanh(x @ a + b)
    return hidden, hidden @ c + d[0]


def descend(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = SEED) -> list[np.ndarray]:
    """Weights of the network, by Adam. Without a prior: positives against unlabelled, logistic loss."""
    draw = np.random.default_rng(seed)
    width = positive.shape[1]
    layers = [draw.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers]
    steps = max(1, min(len(positive), len(unlabelled)) // BATCH)
    step = 0
    for _ in range(max(EPOCHS, STEPS // steps)):
        p_order, u_order = draw.permutation(len(positive)), draw.permutation(len(unlabelled))
        for part in range(steps):
            p, u = positive[p_order[part::steps]], unlabelled[u_order[part::steps]]
            x = np.concatenate([p, u])
            hidden, z = forward(layers, x)
            s, n = sigmoid(z), len(p)
            slope = np.empty(len(x))
            if prior is None:
                slope[:n], slope[n:] = (s[:n] - 1) / n, s[n:] / len(u)
            else:
                d = s * (1 - s)
                negative = s[n:].mean() - prior * s[:n].mean()
                if negative >= 0:
                    slope[:n], slope[n:] = -2 * prior * d[:n] / n, d[n:] / len(u)
                else:
                    slope[:n], slope[n:] = prior * d[:n] / n, -d[n:] / len(u)
            back = np.outer(slope, layers[2]) * (1 - hidden**2)
            grads = [x.T @ back, back.sum(0), hidden.T @ slope, np.array([slope.sum()])]
            step += 1
            for k, g in enumerate(grads):
                g = g + 1e-4 * layers[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                layers[k] = layers[k] - 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return layers


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from the scores of both."""
    cuts = np.unique(np.quantile(positive, np.linspace(0, 0.5, 101)))
    p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    margin = np.sqrt(np.log(40) / 2 / len(unlabelled)) + np.sqrt(np.log(40) / 2 / len(positive))
    best = int(np.argmin((u + margin) / p))
    above = u[best] + 2 * np.sqrt(u[best] * (1 - u[best]) / len(unlabelled))  # two standard errors up: keep in doubt
    return float(np.clip(above / p[best], 0.02, 0.98))


def train(positive: np.ndarray, unlabelled: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> Model:
    model = Model(mean, spread, [], 0.5)
    if len(positive) < 2 or len(unlabelled) < 2:
        return model
    draw = np.random.default_rng(SEED)
    p, u = draw.permutation(model.scaled(positive)), draw.permutation(model.scaled(unlabelled))
    for turn in range(1 + PRIOR_ROUNDS):
        bounds = []
        for a, b in ((0, 1), (1, 0)):  # both halves take their turn
            half = descend(p[a::2], u[a::2], model.prior if turn else None)
            bounds.append(class_prior(forward(half, p[b::2])[1], forward(half, u[b::2])[1]))
        model.prior = float(np.mean(bounds))
    model.layers = descend(p, u, model.prior)
    model.layers[3] = model.layers[3] - valley(forward(model.layers, u)[1], model.prior)
    return model


def valley(z: np.ndarray, prior: float) -> float:
    """Where to cut the unlabelled scores: the sparsest place that leaves about the prior's share above it."""
    z, doubt = np.sort(z), DOUBT + len(z) ** -0.5
    low, high = (int(len(z) * min(1, max(0, 1 - prior + d))) for d in (-doubt, doubt))
    reach = max(1, len(z) // 500)
    ends = np.arange(max(low, reach), min(high, len(z) - reach))
    if not len(ends):
        return 0.0
    at = ends[int(np.argmax(z[ends + reach] - z[ends - reach]))]
    return float((z[at - reach] + z[at + reach]) / 2)


def featured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, features) as a written table."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batch: pa.RecordBatch):
        made = feature_rows(batch, "text")
        yield pa.table({key: batch["key"], "features": pa.array(list(made), pa.list_(pa.float64()))})

    kind = rows.schema["key"].dataType.simpleString()
    return shared(map_batches(rows, run, f"`{key}` {kind}, features array<double>"))


def matrix(rows: DataFrame, bound: int, n: int, key: str) -> np.ndarray:
    """At most about ``bound`` of the ``n`` rows of features, drawn by a hash of their id and features."""
    share = min(1.0, bound / max(1, n))
    draw = F.pmod(F.xxhash64(key, "features", F.lit(SEED)), F.lit(1_000_000)) < int(np.ceil(share * 1_000_000))
    table = rows.where(draw).select("features").limit(2 * bound).toArrow()
    found = np.array(table["features"].to_pylist(), float).reshape(-1, WIDTH)
    return found[np.lexsort(found.T)]  # the order in which tasks answer must not change the model


def fit(rows: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from featured texts and the labels of rows that are not held out."""
    good = (
        labels.select(F.col(key).alias("key"), F.col(label).alias("label"))
        .where(~held_out("key"))
        .groupBy("key")
        .agg(F.min("label").alias("label"))
        .where("label = 1")
    )
    positive = rows.join(good, F.col(key) == F.col("key"), "left_semi")
    sums = [f(F.col("features")[i]) for i in range(WIDTH) for f in (F.avg, F.stddev_pop)]
    n, *stats = rows.agg(F.count("*"), *sums).first()
    stats = np.round(np.array([x or 0.0 for x in stats]), 9).reshape(WIDTH, 2)  # sums differ in their last digits
    mean, spread = stats[:, 0], np.maximum(stats[:, 1], 1e-3)
    return train(matrix(positive, sample, positive.count(), key), matrix(rows, sample, n, key), mean, spread)


def scored(rows: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, held_out, score, predicted) of featured texts."""

    def run(batch: pa.RecordBatch):
        made = np.array(batch["features"].to_pylist(), float).reshape(-1, WIDTH)
        yield pa.table({key: batch[key], "score": pa.array(model.score(made), pa.float64())})

    kind = rows.schema[key].dataType.simpleString()
    out = map_batches(rows.select(key, "features"), run, f"`{key}` {kind}, score double")
    return out.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject."""

    def run(batch: pa.RecordBatch):
        yield batch.filter(pa.array(model.score(feature_rows(batch, text)) >= 0.5))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, run, schema)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    rows = featured(docs, key, text)
    return scored(rows, fit(rows, labels, key, sample=sample), key)
