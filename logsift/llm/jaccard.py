"""N-gram Jaccard join: which texts share at least 75 % of their distinct five-word shingles.

Texts with the same shingles are one node, so copies are never paired. A node has its size, the first of its
shingles in hash order (its keys) and a bitmap of all of them. Two nodes of the wanted similarity have one of their first
n // 4 + 1 shingles in common (prefix filter), so only nodes with a common key can be linked. Of long prefixes the
first ``KEYS`` are enough: hash order is random, so the pair misses each other with chance 0.25 ** 32, less than 2 ** -63,
which is below the chance that two 64-bit shingle hashes are equal by accident.

1. Star rounds: in the group of each key one node is the leader; members that share many keys with it are
   compared with it exactly and linked. That joins large groups of near copies without their pairs.
2. Signature trees: in every group that still has several components, the nodes of a size band are leaves of a
   tree whose inner nodes hold the OR of the bitmaps below and the range of sizes. Two trees are traversed together; a
   pair of tree nodes is left as soon as the most that their texts could share (common bits, and shingles that
   share a bit) is too little for their sizes, or all below is one component. What arrives at the leaves is
   compared exactly.

A group of more than ``BLOCK`` nodes is dealt into blocks by hash, and every two blocks meet in a task of their own, so a
shingle that a third of all texts have is split. Exact comparison reads whole shingle sets; only pairs are ever emitted
that passed the bound. Links and components stay tables.

Null or empty texts and texts of blanks have no shingles and no links. Rows with a null id link like others, but ids named
as components are never null unless all of a component are. Equal rows, and rows with the same id, are rows of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import bound_bytes, components, groups, in_blocks, map_batches, shared, task_count, texts
from logsift.llm.shingles import shingles
from logsift.plans.sizing import join_small

#: Similar: PART * (sizes together) <= WHOLE * (shingles in common), which says a Jaccard index of 3 / 4.
PART, WHOLE = 3, 7
KEYS, STAR_SHARE, STARS, BLOCK, LEAF, FAN = 32, 0.25, 2, 4096, 32, 8
BAND = 1.4  # more than 4 / 3, the largest ratio of similar sizes: partners are in the same or the next band


def bitmap(hashes: np.ndarray) -> bytes:
    """A bit for every shingle in 4 to 8 bits a shingle; widths are powers of two, so wide ones fold."""
    width = 1 << max(6, (4 * len(hashes) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(hashes & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, all at the width of the narrowest."""
    width = min(map(len, maps)) // 8
    return np.array([np.bitwise_or.reduce(np.frombuffer(m, np.uint64).reshape(-1, width), axis=0) for m in maps])


class Tree:
    """Signature tree over nodes in order of their size; level 0 are the leaves, blocks of LEAF rows."""

    def __init__(self, size: np.ndarray, part: np.ndarray, bits: np.ndarray):
        self.size, self.part, self.bits = size, part, bits
        self.spare = size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)  # shingles that share a bit
        self.levels = [self._level(range(0, len(size), LEAF), size, size, self.spare, part, part, bits, LEAF)]
        while len(self.levels[-1][0]) > 1:
            low, high, spare, least, most, union = self.levels[-1]
            self.levels.append(self._level(range(0, len(low), FAN), low, high, spare, least, most, union, FAN))

    @staticmethod
    def _level(starts, low, high, spare, least, most, bits, width):
        cut = [slice(a, a + width) for a in starts]
        return (
            np.array([low[c].min() for c in cut]), np.array([high[c].max() for c in cut]),
            np.array([spare[c].max() for c in cut]), np.array([least[c].min() for c in cut]),
            np.array([most[c].max() for c in cut]), np.array([np.bitwise_or.reduce(bits[c], axis=0) for c in cut]),
        )

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows (i, j) that the bound lets through: traversal of the tree with itself."""
        work = [(len(self.levels) - 1, 0, 0)]
        while work:
            level, a, b = work.pop()
            if not self._possible(level, a, b):
                continue
            if level:
                count = len(self.levels[level - 1][0])
                below = lambda x: range(x * FAN, min((x + 1) * FAN, count))  # noqa: E731, B023
                work += [(level - 1, i, j) for i in below(a) for j in below(b) if a != b or i <= j]
            else:
                yield self._leaves(a, b)

    def _possible(self, level: int, a: int, b: int) -> bool:
        low, high, spare, least, most, bits = self.levels[level]
        if least[a] == most[a] == least[b] == most[b]:
            return False
        common = int(np.bitwise_count(bits[a] & bits[b]).sum()) + min(spare[a], spare[b])
        return WHOLE * min(common, high[a], high[b]) >= PART * (low[a] + low[b])

    def _leaves(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        i, j = (np.arange(x * LEAF, min((x + 1) * LEAF, len(self.size))) for x in (a, b))
        common = np.bitwise_count(self.bits[i][:, None] & self.bits[j][None]).sum(axis=2, dtype=np.int64)
        common += np.minimum.outer(self.spare[i], self.spare[j])
        common = np.minimum(common, np.minimum.outer(self.size[i], self.size[j]))
        good = (WHOLE * common >= PART * np.add.outer(self.size[i], self.size[j])) & np.not_equal.outer(self.part[i], self.part[j])
        if a == b:
            good &= np.less.outer(i, j)
        x, y = np.nonzero(good)
        return i[x], j[y]


def profiles(docs: DataFrame) -> DataFrame:
    """(id, own, n, same, keys, bits) of every row, as a written table."""

    def run(batch: pa.RecordBatch):
        sets = [shingles(t) for t in texts(batch["text"])]
        yield pa.table(
            {
                "id": batch["id"],
                "own": batch["own"],
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "same": pa.array([digest(s) for s in sets], pa.binary()),
                "keys": pa.array([s[: min(len(s) // 4 + 1, KEYS)].view(np.int64) for s in sets], pa.list_(pa.int64())),
                "bits": pa.array([bitmap(s) for s in sets], pa.binary()),
            }
        )

    return shared(map_batches(docs, run, "id long, own long, n long, same binary, keys array<long>, bits binary"))


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def similar_sizes(a: str, b: str) -> Column:
    return F.expr(f"{WHOLE} * least({a}, {b}) >= {PART} * ({a} + {b})")


def text_key(key: str) -> list[Column]:
    """What finds a text: the id of its row, or the text's hash where that is null."""
    return [F.col(key).isNull().alias("none"), F.coalesce(key, "own").alias("source")]


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those (a, b) whose whole shingle sets are similar."""
    pairs = shared(pairs.select("a", "b").distinct())
    involved = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    involved = involved.join(nodes.select("node", *text_key("rep"), "same"), "node")

    def sets(batch: pa.RecordBatch):
        made = [shingles(t) for t in texts(batch["text"])]
        keep = [digest(s) == same for s, same in zip(made, batch["same"].to_pylist(), strict=True)]
        table = pa.table({"node": batch["node"], "hashes": pa.array([s.tobytes() for s in made], pa.binary())})
        yield table.filter(pa.array(keep, pa.bool_()))

    def compare(batch: pa.RecordBatch):
        good = []
        for x, y in zip(batch["x"], batch["y"], strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
            good.append(WHOLE * common >= PART * (len(x) + len(y)))
        yield pa.table({"a": batch["a"], "b": batch["b"]}).filter(pa.array(good, pa.bool_()))

    rows = join_small(docs.select(*text_key("id"), "text"), involved, ["none", "source"])
    found = shared(map_batches(rows.select("node", "same", "text"), sets, "node long, hashes binary").dropDuplicates(["node"]))
    both = pairs.join(found.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(
        found.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b"
    )
    return map_batches(both.select("a", "b", "x", "y"), compare, "a long, b long")


def star_pairs(members: DataFrame, turn: int) -> DataFrame:
    """(a, b): members that share many keys with the leaders of their groups, and are of another component."""
    rank = F.col("rep") if turn == 0 else F.xxhash64("node", F.lit(turn))
    lead = F.min(F.struct(rank.alias("rank"), "node", "n", "part")).alias("lead")
    led = members.join(members.groupBy("key").agg(lead), "key").where("node <> lead.node and part <> lead.part")
    led = led.where(similar_sizes("n", "lead.n")).groupBy(F.col("lead.node").alias("a"), F.col("node").alias("b"))
    return led.agg(F.count("*").alias("shared"), F.first("n").alias("n")).where(
        F.col("shared") >= STAR_SHARE * F.least(F.lit(KEYS), F.expr("n div 4 + 1"))
    )


def tree_pairs(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) of different components that no signature bound rules out."""
    open_keys = members.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most"))
    rows = members.join(open_keys.where("least <> most").select("key"), "key")
    band = F.floor(F.log("n") / np.log(BAND)).cast("int")
    # A node is in the group of its own band, and meets the band below there.
    place = F.explode(F.array(F.struct(band.alias("band"), F.lit(False).alias("upper")), F.struct((band - 1).alias("band"), F.lit(True).alias("upper"))))
    rows = rows.withColumn("place", place).select("key", "place.*", "node", "n", "part")
    sizes = rows.groupBy("key", "band").agg(F.bool_and("upper").alias("above"), F.min("part").alias("least"), F.max("part").alias("most"))
    open_bands = sizes.where("not above and least <> most").select("key", "band")
    rows = in_blocks(rows.join(open_bands, ["key", "band"], "left_semi"), ["key", "band"], "node", BLOCK)
    # Bitmaps, and the keys before this one, come last: only the deal into cells moves them.
    rows = rows.join(nodes.select("node", "bits", "keys"), "node")
    rows = rows.withColumn("keys", F.filter("keys", lambda k: k < F.col("key")))
    cell = ["key", "band", "i", "j"]
    dealt = rows.repartition(task_count(members.sparkSession), *cell).sortWithinPartitions(*cell)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, cell):
            yield from found(group)

    def found(group: pa.Table) -> Iterator[pa.RecordBatch]:
        part = group["part"].to_numpy()
        if part.min() == part.max():
            return
        size = group["n"].to_numpy()
        order = np.argsort(size, kind="stable")
        maps = group["bits"].to_pylist()
        tree = Tree(size[order], part[order], folded([maps[k] for k in order]))
        node, upper, block = (group[c].to_numpy()[order] for c in ("node", "upper", "block"))
        apart = group["i"][0].as_py() != group["j"][0].as_py()
        keys = group["keys"].take(pa.array(order))
        for x, y in tree.pairs():
            keep = ~(upper[x] & upper[y])
            if apart:
                keep &= block[x] != block[y]
            # Pairs with several keys in common are those of the first.
            for at in np.flatnonzero(keep):
                keep[at] = set(keys[int(x[at])].as_py()).isdisjoint(keys[int(y[at])].as_py())
            if keep.any():
                x, y = node[x[keep]], node[y[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame) -> DataFrame:
    """(id, own, n, part, component_id) of every row of (id, own, text); ``part`` is null without shingles."""
    bound_bytes(docs.sparkSession)
    rows = profiles(docs)
    classes = rows.where("n > 0").groupBy("same").agg(
        F.min("id").alias("rep"), F.min("own").alias("own"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits")
    )
    nodes = shared(classes.withColumn("node", F.monotonically_increasing_id()))

    own = nodes.select("node", "rep", "n", F.explode("keys").alias("key"))
    several = own.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    members = shared(own.join(several, "key"))
    links = None
    for turn in range(STARS + 1):
        if links is None:
            now = members.withColumn("part", F.col("node"))
        else:
            now = shared(
                members.join(links.withColumnRenamed("id", "node"), "node", "left")
                .withColumn("part", F.coalesce("component", "node"))
                .drop("component")
            )
        found = verified(star_pairs(now, turn) if turn < STARS else tree_pairs(now, nodes), nodes, docs)
        if links is not None:
            found = found.union(links)
        links = components(found, "a", "b")

    parts = nodes.join(links.withColumnRenamed("id", "node"), "node", "left")
    parts = parts.select("same", "rep", F.coalesce("component", "node").alias("part"))
    least = parts.groupBy("part").agg(F.min("rep").alias("component_id"))
    of = parts.join(least, "part").select("same", "part", "component_id")
    found = rows.select("id", "own", "n", "same").join(of, "same", "left")
    return found.select("id", "own", "n", "part", F.coalesce("component_id", "id").alias("component_id"))


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.lit(1), text).alias("own"), F.col(text).alias("text"))


def join(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row."""
    found = grouped(keyed(df, key, text))
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each group: that with the smallest id, and of its rows the text with the smallest hash.

    Rows without shingles are in no group and stay, all of them.
    """
    found = grouped(keyed(df, key, text))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "own")).alias("first")
    chosen = shared(found.where("part is not null").groupBy("part").agg(first).select("first.id", "first.own"))
    rows = found.where("part is not null").join(chosen, "own", "left_semi").groupBy("id", "own").agg(F.count("*").alias("n"))
    stays = shared(
        chosen.join(rows, chosen["id"].eqNullSafe(rows["id"]) & (chosen["own"] == rows["own"]))
        .select(chosen["id"], chosen["own"], F.col("n").alias("copies"))
        .unionByName(found.where("part is null").select("id", "own", F.lit(1).cast("long").alias("copies")).distinct())
        .select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("none"), "own", "copies")
    )
    number = F.col(key).cast("long")
    whole = df.select(
        F.struct(*df.columns).alias("row"), F.coalesce(number, F.lit(0)).alias("id"), number.isNull().alias("none"),
        F.xxhash64(F.lit(1), text).alias("own"),
    )
    kept = join_small(whole, stays, ["id", "none", "own"])
    if stays.where("copies > 1").limit(1).count():  # rows that are equal in id and text
        several = kept.where("copies > 1").dropDuplicates(["id", "none", "own"])
        kept = kept.where("copies = 1").unionByName(several)
    return kept.select("row.*")
