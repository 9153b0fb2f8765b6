"""Embedding near-dedup by spherical-cap filters.

A filter is a direction on the sphere; a vector falls into it when their inner product reaches a threshold. The directions
are a structured random product code: after a random rotation the components are cut into four blocks, each block has a
small random codebook, and every combination of four codewords is a filter. So the filters a vector exceeds are list-decoded
from four small tables, without looking at all of them. Close vectors exceed mostly the same filters: those that share
one are compared exactly, in double precision.

The code grows with the largest label: with ``SHARE`` of the vectors per filter, or fewer, so that a filter holds some
``TARGET`` vectors. A vector has ``LISTED`` filters in the mean; one that exceeds fewer than ``LEAST`` gets its best
``LEAST``. Of random pairs at a cosine of just 0.98, the hardest that count, these shared no filter: none of 20,000 with 5,000
vectors in the largest label, 4 of 20,000 with 100,000, and 14 of 6,000 with 10,000,000.

Vectors that are equal in label and components are one node. A filter of more than ``BLOCK`` nodes is dealt into blocks, and every two
blocks meet in a task of their own. A pair that shares several filters is counted in the first of them, and no
pairs are emitted: a cell gives each node its number of links, and the smallest node it reaches there.

Null, zero and non-finite vectors, and those without a label, link with nothing and are kept. Vectors of different widths do not
link; those of another width than most, and of fewer than ``NARROW`` components, are compared without filters. Rows without an id count as
links of others; their component is null if no other vector is reached. Equal rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import components, groups, in_blocks, map_batches, shared, task_count

COSINE, BLOCK, BLOCKS, SEED = 0.98, 2048, 4, 5
#: Components below which four blocks make too coarse a code.
NARROW = 16
LISTED, LEAST, SHARE, TARGET = 24, 16, 0.01, 256


@dataclass(frozen=True)
class Code:
    """A product code over ``width`` components, sized for ``count`` vectors."""

    width: int
    count: int

    @cached_property
    def share(self) -> float:
        return min(SHARE, TARGET / max(1, self.count))

    @cached_property
    def words(self) -> int:
        return int(np.ceil((LISTED / self.share) ** (1 / BLOCKS)))

    @cached_property
    def tables(self) -> list[np.ndarray]:
        """Per block the rotated codewords, as columns: the parts of a filter's inner product add up."""
        draw = np.random.default_rng(SEED)
        wide = -(-self.width // BLOCKS) * BLOCKS
        turn = np.linalg.qr(draw.normal(size=(wide, wide)))[0][: self.width]
        out = []
        for block in np.split(turn, BLOCKS, axis=1):
            book = draw.normal(size=(block.shape[1], self.words))
            out.append(block @ (book / np.linalg.norm(book, axis=0)) / BLOCKS**0.5)
        return out

    @cached_property
    def threshold(self) -> float:
        """What a random direction exceeds with the wanted share, from random unit vectors."""
        draw = np.random.default_rng(SEED + 1)
        x = draw.normal(size=(4000, self.width))
        a, b = self.halves(x / np.linalg.norm(x, axis=1, keepdims=True))
        # Sums of the two halves: their upper tail, by sampling.
        pick = draw.integers(0, a.shape[1], (4000, 500))
        sums = np.take_along_axis(a, pick, 1) + np.take_along_axis(b, draw.permuted(pick, axis=1), 1)
        mean, spread = sums.mean(), sums.std()
        if self.share >= 1e-4:
            return float(np.quantile(sums, 1 - self.share))
        from statistics import NormalDist

        return float(mean + spread * NormalDist().inv_cdf(1 - self.share))

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per vector the sums of all pairs of codewords of the first, and of the last two blocks."""
        p, q, r, s = (x @ t for t in self.tables)
        n = len(x)
        return (p[:, :, None] + q[:, None]).reshape(n, -1), (r[:, :, None] + s[:, None]).reshape(n, -1)

    def filters(self, x: np.ndarray) -> list[np.ndarray]:
        """All filters that each unit vector exceeds, at least its best ``LEAST``, in order."""
        out = []
        for a, b in zip(*self.halves(x), strict=True):
            down_a, down_b = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
            a, b = a[down_a], b[down_b]
            top = min(LEAST, len(a))
            best = (a[:top, None] + b[None, :top]).ravel()  # the best sums are among the best halves
            limit = min(self.threshold, np.partition(best, len(best) - top)[len(best) - top] - 1e-12)
            reach = np.searchsorted(-b, a - limit, "right")  # b >= limit - a
            first = np.repeat(np.arange(len(a)), reach)
            second = np.arange(len(first)) - np.repeat(np.cumsum(reach) - reach, reach)
            out.append(np.sort(down_a[first].astype(np.int64) * len(b) + down_b[second]))
        return out


class Everything:
    """One filter that holds every vector."""

    def filters(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.zeros(1, np.int64)] * len(x)


def units(rows: list[bytes], kind: str) -> np.ndarray:
    """Vectors of length one, from packed components."""
    x = np.array([np.frombuffer(r, kind) for r in rows], np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked(x: np.ndarray, code: Code | Everything, own: int, block: np.ndarray, apart: bool) -> tuple[np.ndarray, np.ndarray]:
    """(near, count): which vectors of a cell are linked, and which links are counted in filter ``own``."""
    near = x @ x.T >= COSINE
    np.fill_diagonal(near, False)
    if apart:
        near &= block[:, None] != block[None]
    some = np.flatnonzero(near.any(axis=1))
    count = np.zeros_like(near)
    if len(some):
        earlier = [f[f < own] for f in code.filters(x[some])]
        names, place = np.unique(np.concatenate(earlier), return_inverse=True)
        has = np.zeros((len(some), len(names)), np.float32)
        has[np.repeat(np.arange(len(some)), list(map(len, earlier))), place] = 1
        count[np.ix_(some, some)] = near[np.ix_(some, some)] & (has @ has.T == 0)
    return near, count


def roots(near: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches."""
    least = np.arange(len(near))
    while True:
        now = np.minimum(least, np.where(near, least[None], len(near)).min(axis=1, initial=len(near)))
        now = now[now]
        if (now == least).all():
            return least
        least = now


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    kind = "<f4" if df.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))

    def packed(batch: pa.RecordBatch):
        out = []
        for v, has_label in zip(batch["v"].to_pylist(), batch["label"].is_valid().to_pylist(), strict=True):
            x = np.array([], kind) if v is None or None in v or not has_label else np.array(v, kind)
            out.append(x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
        yield pa.table({"id": batch["id"], "label": batch["label"], "v": pa.array(out, pa.binary())})

    of = rows.schema["label"].dataType.simpleString()
    rows = shared(map_batches(rows, packed, f"id long, label {of}, v binary"))
    valid = rows.where("v is not null")
    nodes = valid.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    nodes = shared(nodes.withColumn("group", F.xxhash64("label")).withColumn("node", F.monotonically_increasing_id()))
    sizes = nodes.groupBy(F.octet_length("v").alias("size")).agg(F.count("*").alias("n"))
    most = nodes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    usual = sizes.orderBy(F.desc("n"), "size").first()
    size = usual["size"] if usual else 0
    width = size // np.dtype(kind).itemsize
    code = Code(width, most) if width >= NARROW else Everything()
    found = cells_of(nodes.where(F.octet_length("v") == size), code, kind)
    # Vectors of another width than most share no code: all of a label and width are compared, in blocks.
    others = nodes.where(F.octet_length("v") != size).withColumn("group", F.xxhash64("label", F.octet_length("v")))
    links = shared(found.unionByName(cells_of(others, Everything(), kind)))

    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    part_of = components(links.where("node <> root"), "node", "root").withColumnRenamed("id", "node")
    whole = (
        nodes.join(counts, "node", "left")
        .join(part_of, "node", "left")
        .select("label", "v", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("part"))
    )
    least = whole.groupBy("part").agg(F.min("rep").alias("component_id"))
    whole = whole.join(least, "part").select("label", "v", "n_links", "component_id")
    component = F.coalesce("component_id", "id")
    return rows.join(whole, ["label", "v"], "left").select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def cells_of(nodes: DataFrame, code: Code | Everything, kind: str) -> DataFrame:
    """(node, links, root): what each cell says of its nodes; links of all cells add up."""

    def listed(batch: pa.RecordBatch):
        rows = batch["v"].to_pylist()
        filters = code.filters(rows if isinstance(code, Everything) else units(rows, kind))
        yield pa.table({"node": batch["node"], "group": batch["group"], "filters": pa.array(filters, pa.list_(pa.int64()))})

    places = map_batches(nodes.select("node", "group", "v"), listed, "node long, group long, filters array<long>")
    places = shared(places.select("node", "group", F.explode("filters").alias("filter")))
    cell = ["group", "filter", "i", "j"]
    dealt = in_blocks(places, ["group", "filter"], "node", BLOCK).join(nodes.select("node", "v", "copies"), "node")
    dealt = dealt.repartition(task_count(nodes.sparkSession), *cell).sortWithinPartitions(*cell)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, cell):
            x = units(group["v"].to_pylist(), kind)
            node, block, copies = (group[c].to_numpy() for c in ("node", "block", "copies"))
            order = np.argsort(node, kind="stable")
            x, node, block, copies = x[order], node[order], block[order], copies[order]
            apart = group["i"][0].as_py() != group["j"][0].as_py()
            near, count = linked(x, code, group["filter"][0].as_py(), block, apart)
            some = np.flatnonzero(near.any(axis=1))
            if len(some):
                root = node[some[roots(near[np.ix_(some, some)])]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[some]), pa.array(count[some].astype(np.int64) @ copies.astype(np.int64)), pa.array(root)], ["node", "links", "root"]
                )

    return dealt.mapInArrow(run, "node long, links long, root long")
