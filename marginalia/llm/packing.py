"""Problem 8: items into containers of fixed capacity by exact-complement hashing.

Only the histogram of sizes is planned on: at most `capacity` numbers, whatever the number of items. The plan first fills
containers exactly: for each size, from the largest, the gap it leaves is looked up among single sizes, sums of
two and sums of three, and combinations are used as often as the counts allow. Each use takes the last of a size and each sum
fails once, so that the time grows with the square of the capacity at most. What is left goes by best fit, largest first,
as many equal containers at a time as there are. The plan is a list of recipes with multiplicities; items get their place
from their rank among items of the same size, which is found in parallel (ranks in buckets of a size, and
offsets of the buckets), so that no size, however frequent, is in one task.

An item larger than the capacity is split into full pieces and a rest; no other is split. Items of size 0 take no room and are
spread over the containers (container 0 if there is none). Null sizes count as 0. Each row is an item of its own, repeated keys included.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET_ROWS = 1_000_000
Recipe = tuple[tuple[int, ...], int]


class _Planner:
    def __init__(self, histogram: Mapping[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for size, count in histogram.items():
            if not 0 < size <= capacity:
                raise ValueError(f"size {size} doesn't fit {capacity}")
            self.left[size] += count
        self.recipes: list[Recipe] = []

    def use(self, sizes: tuple[int, ...]) -> bool:
        """Use the combination as often as counts allow."""
        need = Counter(sizes)
        times = min(self.left[s] // n for s, n in need.items())
        if times <= 0:
            return False
        for s, n in need.items():
            self.left[s] -= n * times
        self.recipes.append((sizes, int(times)))
        return True

    def _pairs(self, total: int, least: int = 1) -> np.ndarray:
        """Sizes b <= total - b, both there, from the largest b on."""
        b = np.arange(total // 2, least - 1, -1)
        return b[(self.left[b] > (2 * b == total)) & (self.left[total - b] > 0)]

    def exact(self) -> None:
        cap = self.capacity
        self.use((cap,))
        for a in range(cap - 1, 0, -1):
            if self.left[a]:
                self.use((a, cap - a))
        for a in range(cap - 2, 0, -1):
            for b in self._pairs(cap - a) if self.left[a] else ():
                if not self.left[a]:
                    break
                self.use((a, int(cap - a - b), int(b)))
        there = (self.left > 0).astype(np.float32)
        sums = np.rint(np.fft.irfft(np.fft.rfft(there, 2 * cap + 2) ** 2, 2 * cap + 2)) if there.any() else there
        for a in range(cap - 3, 0, -1):
            if not self.left[a]:
                continue
            gap = cap - a
            b = np.arange(min(a, gap - 2), 0, -1)
            b = b[(self.left[b] > 0) & (sums[gap - b] > 0)]
            for x in b.tolist():
                if not self.left[a]:
                    break
                if not self.left[x] or not sums[gap - x]:
                    continue
                pairs = self._pairs(gap - x)
                if not len(pairs):
                    # Counts only fall: a sum that can't be made is never looked for again.
                    sums[gap - x] = 0
                for y in pairs:
                    if not self.left[a] or not self.left[x]:
                        break
                    self.use((a, x, int(gap - x - y), int(y)))

    def best_fit(self) -> None:
        gaps: list[int] = []
        open_: dict[int, list[list]] = {}

        def put(content: tuple[int, ...], times: int, gap: int) -> None:
            if not gap:
                self.recipes.append((content, times))
            elif gap in open_:
                open_[gap].append([content, times])
            else:
                bisect.insort(gaps, gap)
                open_[gap] = [[content, times]]

        for size in range(self.capacity, 0, -1):
            count = int(self.left[size])
            while count:
                at = bisect.bisect_left(gaps, size)
                if at < len(gaps):
                    gap = gaps[at]
                    group = open_[gap][-1]
                    times = min(count, group[1])
                    group[1] -= times
                    if not group[1]:
                        open_[gap].pop()
                        if not open_[gap]:
                            del open_[gap]
                            gaps.pop(at)
                    put((*group[0], size), times, gap - size)
                    count -= times
                else:
                    each = self.capacity // size
                    times, rest = divmod(count, each)
                    if times:
                        put((size,) * each, times, self.capacity - each * size)
                    if rest:
                        put((size,) * rest, 1, self.capacity - rest * size)
                    count = 0
            self.left[size] = 0
        self.recipes += [(content, times) for groups in open_.values() for content, times in groups]


def plan(histogram: Mapping[int, int], capacity: int) -> list[Recipe]:
    """Recipes (sizes, times) that use each item of the histogram once."""
    planner = _Planner(histogram, capacity)
    planner.exact()
    planner.best_fit()
    return planner.recipes


def slots(recipes: list[Recipe]) -> tuple[np.ndarray, int]:
    """Rows (size, from rank, uses, first container) sorted by size and rank, and the number of containers."""
    rows, used, container = [], Counter(), 0
    for sizes, times in recipes:
        for size, uses in Counter(sizes).items():
            rows.append((size, used[size], uses, container))
            used[size] += uses * times
        container += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4), container


def pack(items: DataFrame, key: str, size: str, windows: Mapping[str, int]) -> DataFrame:
    """(window_name, capacity, container_no, key, piece_no, start_token, tokens) of all items (key, size) for each window.

    `items` is read twice; give it from a written table if it is dear to make.
    """
    if any(c <= 0 for c in windows.values()):
        raise ValueError("a capacity must be positive")
    named = F.explode(F.create_map(*[F.lit(x) for w in windows.items() for x in w])) if windows else F.explode(F.lit(None).cast("map<string,int>"))
    rows = items.select(F.col(key).alias("id_"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n_"))
    rows = rows.select("id_", "n_", named.alias("window_name", "capacity"))
    pieces = rows.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr("cast((n_ - 1) div capacity as int)")))).alias("piece_no"))
    pieces = pieces.select("window_name", "capacity", "id_", "piece_no", (F.col("piece_no").cast("bigint") * F.col("capacity")).alias("start_token"), F.least(F.col("n_") - F.col("piece_no").cast("bigint") * F.col("capacity"), F.col("capacity").cast("bigint")).cast("int").alias("tokens"))
    histogram: dict[str, dict[int, int]] = {w: {} for w in windows}
    for r in pieces.groupBy("window_name", "tokens").count().collect():
        histogram[r.window_name][r.tokens] = r["count"]
    buckets = max(16, -(-max((sum(h.values()) for h in histogram.values()), default=0) // BUCKET_ROWS))
    tables = {w: slots(plan({s: n for s, n in h.items() if s}, windows[w])) for w, h in histogram.items()}

    pieces = pieces.withColumn("bucket_", F.pmod(F.xxhash64("id_", "piece_no"), F.lit(buckets)))
    sizes = pieces.groupBy("window_name", "tokens", "bucket_").agg(F.count("*").alias("here"))
    before = F.sum("here").over(Window.partitionBy("window_name", "tokens").orderBy("bucket_")) - F.col("here")
    offsets = sizes.select("window_name", "tokens", "bucket_", before.alias("before"))
    within = Window.partitionBy("window_name", "tokens", "bucket_").orderBy("id_", "piece_no")
    ranked = pieces.withColumn("within", F.row_number().over(within) - 1).join(offsets, ["window_name", "tokens", "bucket_"])

    def place(window: pa.Array, tokens: pa.Array, rank: pa.Array) -> pa.Array:
        names = np.asarray(window.to_pylist(), object)
        tokens, rank = np.asarray(tokens).astype(np.int64), np.asarray(rank).astype(np.int64)
        out = np.zeros(len(rank), np.int64)
        for name, (table, containers) in tables.items():
            mine = np.flatnonzero(names == name)
            empty = mine[tokens[mine] == 0]
            out[empty] = rank[empty] % max(containers, 1)
            mine = mine[tokens[mine] > 0]
            if len(mine):
                keys = table[:, 0] * (1 << 44) + table[:, 1]
                at = np.searchsorted(keys, tokens[mine] * (1 << 44) + rank[mine], "right") - 1
                out[mine] = table[at, 3] + (rank[mine] - table[at, 1]) // table[at, 2]
        return pa.array(out)

    container = F.arrow_udf(place, T.LongType())("window_name", "tokens", F.col("before") + F.col("within"))
    return ranked.select("window_name", "capacity", container.alias("container_no"), F.col("id_").alias(key), "piece_no", "start_token", "tokens")
