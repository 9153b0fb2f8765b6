"""Exact top-k search by integer inner products, term at a time.

Components are quantised to floor(scale * x). Queries and candidates are dealt into blocks of bounded size and
every block of queries meets every block of candidates in a task. There the candidates become postings, one
list per term (component) with the rows that are not zero in it. For each term the queries that have it
scatter their weight times the posting's weights into dense score arrays. A partition selection keeps the k
best of a block, ties to the smaller id, and a ranked merge over the blocks keeps the k best of all.

Vectors that are null or hold null or non-finite components take no part. A missing component of a shorter vector is zero. A
query is a row: every other row is a candidate for it, those with the same id or without an id too, and rows that share an id and are queries
have a result each. Ties go to the smaller id, no id comes last. Ids are integers. Scores beyond 64 bits saturate before they are ranked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.common import shared

QUERIES, CANDIDATES, ROWS_AT_ONCE = 2048, 4096, 64
LONG = np.iinfo(np.int64)


def usable(vector: str) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def quantised(vectors: list[np.ndarray], scale: float) -> np.ndarray:
    """Rows of floor(scale * x), as 64-bit integers where products of them cannot overflow, else as exact ones."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width))
    for row, vector in enumerate(vectors):
        out[row, : len(vector)] = np.floor(scale * np.asarray(vector, np.float64))
    if not out.size or np.abs(out).max() < 2.0**31 / (width + 1) ** 0.5:
        return out.astype(np.int64)
    exact = np.vectorize(lambda x: int(x) if np.isfinite(x) else LONG.max * int(np.sign(x)), otypes=[object])
    return exact(out)


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products, by adding up one term after the other."""
    kind = object if object in (queries.dtype, candidates.dtype) else np.int64
    out = np.zeros((len(queries), len(candidates)), kind)
    for term in range(min(queries.shape[1], candidates.shape[1])):
        rows, posting = np.flatnonzero(queries[:, term]), np.flatnonzero(candidates[:, term])
        if not len(rows) or not len(posting):
            continue
        weights = candidates[posting, term]
        for row in rows:
            if len(posting) == len(candidates):
                out[row] += queries[row, term] * weights
            else:
                out[row, posting] += queries[row, term] * weights
    if kind is object:
        out = np.array([[min(max(x, LONG.min), LONG.max) for x in row] for row in out], np.int64).reshape(out.shape)
    return out


def best(score: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller place in ``order``."""
    keep = np.arange(len(score))
    if len(score) > k:
        keep = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return keep[np.lexsort((order[keep], ~score[keep]))][:k]  # ~ turns the order round without overflow


def top_k(
    df: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0,
    queries: int = QUERIES, candidates: int = CANDIDATES,
) -> DataFrame:
    """(query_id, rank, id, score): per query the k best of all other rows."""
    rows = df.where(usable(vector)).select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = shared(rows)
    n, asked = rows.agg(F.count("*"), F.coalesce(F.count_if("q"), F.lit(0))).first()
    blocks, query_blocks = -(-n // candidates) or 1, -(-asked // queries) or 1

    def block(count: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    # Rows of the block they are in, once for every block of the other side.
    asking = rows.where("q").select("row", "id", "v", F.lit(True).alias("q"), block(query_blocks, 1).alias("qb"), every(blocks).alias("cb"))
    offered = rows.select("row", "id", "v", F.lit(False).alias("q"), every(query_blocks).alias("qb"), block(blocks, 2).alias("cb"))

    def meet(group: pa.Table) -> pa.Table:
        rows, asks = group["row"].to_numpy(), group["q"].to_numpy()
        vectors = quantised([np.array(v, np.float64) for v in group["v"].to_pylist()], scale)
        keys = np.lexsort((rows, group["id"].fill_null(0).to_numpy(), group["id"].is_null().to_numpy()))
        mine, others = keys[asks[keys]], keys[~asks[keys]]
        found = []
        for at in range(0, len(mine), ROWS_AT_ONCE):
            part = mine[at : at + ROWS_AT_ONCE]
            for row, score in zip(part, scores(vectors[part], vectors[others]), strict=True):
                foreign = rows[others] != rows[row]
                own, score = others[foreign], score[foreign]
                for place in best(score, np.arange(len(own)), k):
                    found.append((row, own[place], score[place]))
        asked, answers, points = (np.array(x, np.int64) for x in (zip(*found, strict=True) if found else [[]] * 3))
        columns = [group["row"].take(asked), group["id"].take(asked), group["row"].take(answers), group["id"].take(answers), pa.array(points)]
        return pa.table(dict(zip(["query", "query_id", "row", "id", "score"], columns, strict=True)))

    near = asking.unionByName(offered).groupBy("qb", "cb").applyInArrow(meet, "query long, query_id long, row long, id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")
