"""Best-fit packing of token pieces into sequences of a fixed length.

Only the histogram of piece lengths goes to the driver: at most ``size`` numbers, whatever the corpus. There
the configuration linear program is solved: a configuration is a multiset of lengths that fits a sequence,
and as few as possible are to cover every length as often as it occurs. Multiplicative weights price the
lengths, a knapsack dynamic program finds the best configuration for those prices, and the weights of the
lengths it covers shrink. The fractional uses are rounded down, then up where all pieces are still there,
and best fit decreasing places the few pieces left over. The prices also give a lower bound of the dual program.
While the best plan is more than ``GAP`` above it, the steps of the weights are halved, each with several ``RATES``,
until that closes less than a tenth of the gap or they reach ``LEAST_STEP``. A round covers a step of a length or all of
it, so a plan has at most size / LEAST_STEP + size configurations plus the leftovers of each, whatever the corpus.

Pieces get their place by rank among the pieces of their length. Every row of the written pieces has a number; a
length is split by it into salts of about ``RANKED`` rows, ranks are counted in each and added up over the salts. So a
length, a key or a text that a third of all pieces have is split, and a task ranks the same rows when it is repeated.
Which of two pieces of a length comes first depends on the order of the input.

Null texts are empty. An empty text is one piece: the end token alone. Repeated rows are packed
as often as they occur. A null key is a key of its own. Other columns of the pieces stay, whatever their names;
columns called sequence_id or offset are replaced.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.bpe import codec
from logsift.llm.common import map_batches, shared, texts
from logsift.plans.sizing import join_small

SIZE, END = 1024, 2
#: Prices begin at length ** POWER, a little in favour of long pieces, and shrink by exp(-rate * share covered).
POWER, RATES = 1.1, (0.3, 1.0, 3.0)
#: A plan within this share of the lower bound is taken at once; steps are not halved further below LEAST_STEP.
GAP, LEAST_STEP = 1e-4, 1 / 32
#: Lengths below it extend the knapsack's table one by one.
BLOCK = 64
#: Pieces of a length that are ranked together, about; the counts of the groups are a thousandth of the rows.
RANKED = 1 << 10


def token_pieces(
    df: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END,
    keep_ids: bool = False,
) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of every text's ids and the end token.

    Texts of more than ``size`` ids are cut into pieces of ``size``; their first piece may be shorter.
    """

    def run(batch: pa.RecordBatch):
        rows, starts, lengths, pieces, sums, kept = [], [], [], [], [], []
        for row, t in enumerate(texts(batch["text"])):
            ids = np.append(codec(path).encode(t), np.uint32(end)).astype("<u4")
            first = len(ids) % size or size
            cuts = [0, *range(first, len(ids) + 1, size)]
            for piece, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
                data = ids[low:high].tobytes()
                rows.append(row)
                starts.append(low)
                lengths.append(high - low)
                pieces.append(piece)
                sums.append(zlib.crc32(data))
                if keep_ids:
                    kept.append(data)
        out = {
            key: batch["key"].take(pa.array(rows, pa.int64())),
            "piece": pa.array(pieces, pa.int32()),
            "start": pa.array(starts, pa.int64()),
            "length": pa.array(lengths, pa.int64()),
            "ids_crc32": pa.array(sums, pa.int64()),
        }
        yield pa.table(out | ({"ids": pa.array(kept, pa.binary())} if keep_ids else {}))

    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema["key"].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long"
    return map_batches(docs, run, schema + (", ids binary" if keep_ids else ""))


def best_configuration(size: int, lengths: np.ndarray, prices: np.ndarray) -> tuple[Counter, float]:
    """The multiset of lengths of the highest total price that fits ``size``, and that price: an unbounded knapsack.

    Short lengths extend the table one after the other, along chains of rooms that are a copy apart; the others
    fill it block by block of rooms, a block being no longer than the shortest of them.
    """
    best = np.zeros(size + 1)
    few = int(np.searchsorted(lengths, BLOCK))
    for length, price in zip(lengths[:few].tolist(), prices[:few].tolist(), strict=True):
        rows = size // length + 1
        chain = np.full(rows * length, -np.inf)
        chain[: size + 1] = best[: rows * length]
        copies = price * np.arange(rows)[:, None]
        best = (np.maximum.accumulate(chain.reshape(rows, length) - copies) + copies).ravel()[: size + 1]
    padded = np.concatenate([np.full(size, -np.inf), best])
    best = padded[size:]
    longer, worth = lengths[few:], prices[few:]
    block = int(longer[0]) if len(longer) else size + 1
    for low in range(block, size + 1, block):
        rooms = np.arange(low, min(low + block, size + 1))
        n = int(np.searchsorted(longer, rooms[-1], "right"))
        value = (padded[rooms[:, None] + size - longer[:n]] + worth[:n]).max(axis=1)
        np.maximum(best[rooms], value, out=best[rooms[0] : rooms[-1] + 1])
    found, room = Counter(), size
    while fits := int(np.searchsorted(lengths, room, "right")):
        value = best[room - lengths[:fits]] + prices[:fits]
        at = int(value.argmax())
        if value[at] < best[room] * (1 - 1e-12):
            room -= 1
        else:
            found[int(lengths[at])] += 1
            room -= int(lengths[at])
    return found, float(best[size])


def solve(histogram: dict[int, int], size: int, step: float, rate: float) -> tuple[dict[tuple, float], float]:
    """Fractional uses of configurations that cover the histogram, by multiplicative weights, and a lower bound.

    A round uses a configuration until it covers ``step`` of one of its lengths, or the rest of one. Prices shrink by
    exp(-rate * share covered). Prices over the price of the best configuration are a solution of the dual program,
    so no packing has fewer sequences than the bound.
    """
    count = np.zeros(size + 1)
    for length, n in histogram.items():
        count[length] = n
    covered, uses, bound = np.zeros(size + 1), defaultdict(float), 0.0
    every = np.count_nonzero(count)
    while len(open_lengths := np.flatnonzero(covered < count)):
        share = covered[open_lengths] / count[open_lengths]
        prices = open_lengths**POWER * np.exp(-rate * share)
        config, price = best_configuration(size, open_lengths, prices)
        if len(open_lengths) == every:
            bound = max(bound, float(prices @ count[open_lengths]) / price)
        times = min(min(step * count[x], count[x] - covered[x]) / c for x, c in config.items())
        uses[tuple(sorted(config.items()))] += times
        for length, copies in config.items():
            covered[length] += times * copies
        done = np.abs(covered - count) < 1e-9 * np.maximum(count, 1)
        covered[done] = count[done]
    return uses, bound


def rounded(uses: dict[tuple, float], histogram: dict[int, int], size: int) -> list[tuple[tuple, int]]:
    """Whole uses: rounded down, then up while the pieces last, and best fit decreasing for the few left."""
    left, out = Counter(histogram), []

    def use(config: tuple, times: int) -> None:
        if (times := min([times, *(left[x] // c for x, c in config)])) > 0:
            out.append((config, times))
            left.subtract({x: c * times for x, c in config})

    order = sorted(uses.items(), key=lambda x: (-x[1], x[0]))
    for config, times in order:
        use(config, int(times + 1e-9))
    for config, times in order:
        use(config, int(np.ceil(times % 1 - 1e-9)))
    rest = Counter(tuple(sorted(Counter(x).items())) for x in best_fit(left.elements(), size))
    return [*out, *rest.items()]


def plan(
    histogram: dict[int, int], size: int = SIZE, gap: float = GAP, least_step: float = LEAST_STEP
) -> list[tuple[tuple, int]]:
    """Configurations ((length, copies), ...) and how many sequences use each; covers every piece once."""
    left = {k: v for k, v in histogram.items() if v and k != size}
    full = [(((size, 1),), histogram[size])] if histogram.get(size) else []
    if not left:
        return full
    bound = sum(k * v for k, v in left.items()) / size
    best, used, step = None, np.inf, 1.0
    while step >= least_step:
        before = used
        for rate in RATES:
            uses, dual = solve(left, size, step, rate)
            bound = max(bound, dual)
            tried = rounded(uses, left, size)
            if (n := sum(times for _, times in tried)) < used:
                best, used = tried, n
            over = used - np.ceil(bound - 1e-6)
            if over <= gap * used:
                return [*full, *best]
        if before - used < over / 10:
            break
        step /= 2
    return [*full, *best]


def best_fit(lengths, size: int) -> list[list[int]]:
    """Best fit decreasing: the fullest sequence with room takes the next longest piece."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, (length, -1))
        room, number = rooms.pop(at) if at < len(rooms) else (size, len(bins))
        if number == len(bins):
            bins.append([])
        bins[number].append(length)
        bisect.insort(rooms, (room - length, number))
    return bins


def places(chosen: list[tuple[tuple, int]]) -> dict[int, np.ndarray]:
    """Per length, columns first rank, first sequence, copies in a sequence, offset in it."""
    rows, taken, sequence = defaultdict(list), Counter(), 0
    for config, times in chosen:
        offset = 0
        for length, copies in config:
            rows[length].append((taken[length], sequence, copies, offset))
            taken[length] += copies * times
            offset += copies * length
        sequence += times
    return {length: np.array(x, np.int64).T for length, x in rows.items()}


def pack(
    pieces: DataFrame, size: int = SIZE, gap: float = GAP, least_step: float = LEAST_STEP, ranked: int = RANKED
) -> DataFrame:
    """``pieces`` with sequence_id and offset; only their column length, from 1 to ``size``, is looked at."""
    spark = pieces.sparkSession
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = shared(pieces.select(F.struct(*kept).alias("row"), F.monotonically_increasing_id().alias("number")))
    rows = rows.withColumn("length", F.col("row.length").cast("long"))
    histogram = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = spark.sparkContext.broadcast(places(plan(histogram, size, gap, least_step)))
    salts = spark.createDataFrame([(x, n // ranked + 1) for x, n in histogram.items()], "length long, salts long")
    rows = rows.join(F.broadcast(salts), "length")  # at most size rows
    rows = rows.withColumn("salt", F.expr("pmod(xxhash64(number), salts)")).drop("salts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    groups = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("number")
    placed = join_small(rows.withColumn("rank", F.row_number().over(order) - 1), groups, ["length", "salt"])
    placed = placed.select("row", "length", (F.col("rank") + F.col("before")).alias("rank"))

    def run(batch: pa.RecordBatch):
        length = batch["length"].to_numpy(zero_copy_only=False)
        rank = batch["rank"].to_numpy(zero_copy_only=False)
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for x in np.unique(length):
            own = np.flatnonzero(length == x)
            first, number, copies, begin = where.value[int(x)]
            at = np.searchsorted(first, rank[own], "right") - 1
            nth = rank[own] - first[at]
            sequence[own] = number[at] + nth // copies[at]
            offset[own] = begin[at] + nth % copies[at] * x
        columns = {c: batch["row"].field(i) for i, c in enumerate(kept)}
        yield pa.table(columns | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in kept)
    return map_batches(placed, run, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(sequence_id, ids, members) from packed pieces that keep their ids; a sequence has ``size`` ids at most."""
    own = F.array_sort(F.collect_list(F.struct("offset", F.col(key).alias("key"), "piece", "length", F.hex("ids").alias("ids"))))
    return packed.groupBy("sequence_id").agg(own.alias("own")).select(
        "sequence_id",
        F.unhex(F.array_join(F.col("own.ids"), "")).alias("ids"),
        F.transform("own", lambda x: F.struct(x["key"].alias(key), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("members"),
    )
