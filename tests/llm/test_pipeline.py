"""The stages one by one against brute-force versions of their own decisions."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from test_jaccard import brute as brute_join
from test_suffix_dedup import brute as brute_repeats
from tokenizers import Tokenizer

import __spark_entry__ as contract
from logsift.llm import quality, secrets, stages

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, out[-1], FOLDER).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [{r.doc_id: r for r in df.collect()} if "text" in df.columns else df.collect() for df in out]


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "suffix_array_dedup", "secret_scans", "best_fit_packing"]
    for step in steps[:-1]:
        assert next(iter(step.values())).__fields__ == COLUMNS
    assert "pipeline" in contract.queries()


def test_quality(spark, steps):
    before, after = steps[:2]
    model = quality.fit(quality.featured(spark.read.parquet(f"{FOLDER}/documents.parquet")), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    score = dict(zip(before, model.score(np.array([quality.features(r.text) for r in before.values()])), strict=True))
    assert after == {k: r for k, r in before.items() if score[k] >= 0.5}
    assert 0.6 * len(before) < len(after) < len(before)


def test_join(steps):
    before, after = steps[1:3]
    component = {k: c for k, _, c in brute_join([(k, r.text) for k, r in before.items()])}
    assert after == {k: r for k, r in before.items() if component[k] == k}


def test_repeats(steps):
    before, after = steps[2:4]
    want = {k: kept.decode("utf-8", "ignore") for k, _, _, _, kept in brute_repeats([(k, r.text) for k, r in before.items()], 100)}
    assert {k: r.text for k, r in after.items()} == want
    assert all(r.n_chars == len(r.text) and r[2:4] == before[k][2:4] for k, r in after.items())


def test_secrets(steps):
    before, after = steps[3:5]
    for k, r in before.items():
        assert after[k].text == secrets.mask(r.text, secrets.find(r.text))
        assert not secrets.base_spans(after[k].text)
    assert len(after) == len(before)


def test_packing(steps):
    docs, rows = steps[4:6]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {k: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for k, r in docs.items()}
    total = dict.fromkeys(docs, 0)
    for r in rows:
        total[r.doc_id] += r.length
    assert total == lengths
    assert len({r.sequence_id for r in rows}) <= -(-sum(lengths.values()) // 1024) * 1.06 + 1


def test_odd_rows(spark, tmp_path):
    """Nulls, empty texts and repeated rows pass through every stage."""
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words of a text, and more", "en", "s", 30), (3, "x" * 50_000, "en", "s", 50_000)]
    rows += [(4, "the same text here, two times", "en", "s", 29)] * 2 + [(4, "another text under this id", "en", "s", 26)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for number, data in enumerate((rows, [])):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            path = f"{tmp_path}/{name}{number}"
            stage(spark, docs, FOLDER).write.parquet(path)
            docs = spark.read.parquet(path)
            assert "text" not in docs.columns or docs.columns == COLUMNS
        if number:
            assert docs.count() == 0
    kept = stages.distinct(spark, spark.createDataFrame(rows, schema), FOLDER).collect()
    assert sorted(map(repr, kept)) == sorted(map(repr, {repr(r): r for r in spark.createDataFrame(rows, schema).collect()}.values()))


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
