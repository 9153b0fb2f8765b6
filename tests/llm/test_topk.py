import math
import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import oracle
from pyspark.sql import functions as F

from logsift.llm import topk
from logsift.llm.registry import SQL, op5_topk


def limited(x):
    return min(max(x, -(2**63)), 2**63 - 1)


def brute(rows, k):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(whole):
        if q is not None and q % 5 == 0:
            others = [(-limited(sum(a * b for a, b in zip(v, w, strict=False))), i is None, i or 0, i) for m, (i, w) in enumerate(whole) if m != n]
            out += [(q, n, best[3], -best[0]) for n, best in enumerate(sorted(others)[:k], 1)]
    return sorted(out, key=repr)


def run(spark, rows, k, **sizes):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, rank int, q string")
    found = topk.top_k(df, F.col("vec_id") % 5 == 0, k, **sizes)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_against_brute_force(spark):
    draw = random.Random(2)
    rows = [(i, [draw.choice([0.0, 0.0, 0.01, -0.5, 1.0, draw.uniform(-2, 2)]) for _ in range(6)]) for i in range(300)]
    rows += [(i + 300, [0.5] * 6) for i in range(40)]  # ties
    rows += [(400, None), (405, [1.0, None]), (410, [float("nan")]), (415, [float("inf"), 1.0]), (None, [1.0] * 6), (420, []), (425, [3.0]), (3, [9.0] * 6), (5, [0.0] * 6), (5, [0.0] * 6), (-10, [1.0] * 6)]
    assert run(spark, rows, 4, queries=7, candidates=30) == brute(rows, 4)
    assert run(spark, rows, 4) == brute(rows, 4)


def test_few_rows_and_large_numbers(spark):
    assert run(spark, [(0, [1.0])], 5) == []
    assert run(spark, [(0, [1.0]), (1, [2.0]), (5, [1.0])], 5) == brute([(0, [1.0]), (1, [2.0]), (5, [1.0])], 5)
    assert run(spark, [], 5) == []
    big = [(0, [1e12, 1.0]), (1, [1e12, -1e12]), (5, [1e300, 1.0]), (7, [-1e300, 0.5])]
    assert run(spark, big, 3) == brute(big, 3)


def test_repeated_and_missing_ids(spark):
    rows = [(0, [1.0]), (1, [0.5]), (None, [2.0]), (2, [0.9]), (2, [0.1]), (0, [0.25]), (None, [2.0]), (None, None)]
    got = run(spark, rows, 3)
    assert got == brute(rows, 3) and sum(r[2] is None for r in got) == 4 and len(got) == 6
    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    odd = table.union(table.where("vec_id % 7 < 2").withColumn("vec_id", F.when(F.col("vec_id") % 2 == 0, F.col("vec_id"))))
    connection = oracle.connect(folder)
    connection.register("odd", odd.toArrow())
    connection.sql("create or replace view embeddings as select * from odd")
    assert oracle.compare(topk.top_k(odd, F.col("vec_id") % 50 == 0, 5), connection, SQL["op5_topk"]) is None


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    assert oracle.compare(op5_topk(spark, folder), oracle.connect(folder), SQL["op5_topk"]) is None
