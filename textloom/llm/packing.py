"""Filling containers of fixed capacity with items, by patterns.

Sizes are put on a grid. Patterns of few grid sizes that fill a container are enumerated, and non-negative least
squares finds how often each should be used so that together they use up the histogram of sizes. The counts are
rounded; each use of a pattern takes its items, of a neighbouring grid size where one has run out, and the last one as the
largest that still fits. A container that would stay emptier than largest-first packing leaves them is given up, and what is
left is packed largest first. Of that and largest-first packing of all items the better one is kept. Items are spread over
shards of bounded size which are packed independently, so the space lost is at most about one container a shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Grid steps of a container's capacity.
GRID = 48
#: Items meant for one shard.
SHARD_ITEMS = 40_000
#: Documents of a pattern, where sizes are large; sizes of a pattern, each taken any number of times, where they are small.
PATTERN_ITEMS = 4


def patterns(bins: list[int], grid: int = GRID) -> np.ndarray:
    """Columns: how many items of each grid size; every column fills the grid exactly."""
    found: set[tuple[int, ...]] = set()
    for m in range(1, PATTERN_ITEMS):
        for head in combinations_with_replacement(bins, m):
            rest = grid - sum(head)
            if rest >= head[-1] and rest in bins:
                found.add((*head, rest))
    if grid in bins:
        found.add((grid,))
    small = [b for b in bins if b * PATTERN_ITEMS < grid]
    for a, b in combinations_with_replacement(small, 2):
        for n in range(1, grid // a + 1):
            rest = grid - n * a
            if rest == 0 or rest % b == 0:
                found.add((a,) * n + (b,) * (rest // b))
    out = np.zeros((grid + 1, len(found)))
    for j, p in enumerate(sorted(found)):
        for b in p:
            out[b, j] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """min |ax - b| over x >= 0, by an active set."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        if not len(gain) or gain.max() <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        active[gain.argmax()] = True
        while active.any():
            at = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 1e-12).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 1e-12
            step = np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300))
            x[at] += step * (z - x[at])
            active[at[low & (x[at] <= 1e-12)]] = False
            active[at[x[at] <= 1e-12]] = False
            x[~active] = 0
    return x


class Pool:
    """Items by size, with the sizes in stock as the bits of one integer."""

    def __init__(self, sizes: np.ndarray):
        self.stock: dict[int, list[int]] = {}
        for i, s in enumerate(sizes.tolist()):
            self.stock.setdefault(s, []).append(i)
        self.mask = sum(1 << s for s in self.stock)

    def take(self, at_most: int, at_least: int = 0) -> tuple[int, int] | None:
        """The largest item within bounds."""
        size = (self.mask & ((1 << (at_most + 1)) - 1)).bit_length() - 1
        if size < at_least:
            return None
        items = self.stock[size]
        item = items.pop()
        if not items:
            del self.stock[size]
            self.mask &= ~(1 << size)
        return size, item

    def put(self, size: int, item: int) -> None:
        self.stock.setdefault(size, []).append(item)
        self.mask |= 1 << size


def largest_first(pool: Pool, out: np.ndarray, capacity: int, used: int, gaps: list[tuple[int, int]]) -> int:
    """All items of the pool into the gaps of containers, then into new ones; the number of containers then."""
    for space, at in gaps:
        while space and (got := pool.take(space, 1)):
            out[got[1]] = at
            space -= got[0]
    while pool.mask:
        space = capacity
        while space and (got := pool.take(space, 1)):
            out[got[1]] = used
            space -= got[0]
        used += 1
    return used


def by_patterns(sizes: np.ndarray, capacity: int, waste: float) -> tuple[np.ndarray, int]:
    """The container of each item and their number; a pattern's container may leave `waste` of its space unused."""
    out, pool, used = np.zeros(len(sizes), np.int64), Pool(sizes), 0
    grid = np.clip(np.rint(sizes * GRID / capacity).astype(int), 1, GRID)
    count = np.bincount(grid, minlength=GRID + 1).astype(float)
    table = patterns(np.flatnonzero(count).tolist())
    gaps: list[tuple[int, int]] = []
    if table.shape[1]:
        repeat = np.rint(nnls(table, count)).astype(int)
        edge = [int(np.ceil((g - 0.5) * capacity / GRID)) for g in range(GRID + 3)]
        for j in np.argsort(-repeat, kind="stable"):
            shape = np.repeat(np.arange(GRID + 1), table[:, j].astype(int))[::-1].tolist()
            for _ in range(repeat[j]):
                space, taken = capacity, []
                for k, g in enumerate(shape):
                    if k == len(shape) - 1:
                        got = pool.take(space, 1)
                    else:
                        got = pool.take(min(space, edge[g + 1] - 1), max(1, edge[g])) or pool.take(min(space, edge[g + 2] - 1), max(1, edge[max(0, g - 1)]))
                    if got is None:
                        break
                    taken.append(got)
                    space -= got[0]
                if len(taken) < len(shape) or space > waste * capacity:
                    for size, item in taken:
                        pool.put(size, item)
                    break
                for _size, item in taken:
                    out[item] = used
                if space:
                    gaps.append((space, used))
                used += 1
    return out, largest_first(pool, out, capacity, used, gaps)


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; sizes lie between 0 and capacity. Items of size 0 go into container 0."""
    out, some = np.zeros(len(sizes), np.int64), np.flatnonzero(sizes > 0)
    own = sizes[some]
    plain = np.zeros(len(own), np.int64)
    used = largest_first(Pool(own), plain, capacity, 0, [])
    waste = 1 - own.sum() / (used * capacity) if used else 0.0
    found, n = by_patterns(own, capacity, waste) if used else (plain, used)
    out[some] = found if n <= used else plain
    return out


def fill_containers(items: DataFrame, budgets: list[tuple[int, int]], shards: int) -> DataFrame:
    """items (doc_id, n_tokens) -> budget_id, doc_id, piece_no, start_token, n_tokens, container_id.

    budgets: (budget_id, capacity). An item larger than the capacity is cut into full pieces, one container each, and
    its rest; no other item is split. An item of size 0 or null takes no space and is still assigned. Items with the
    same doc_id are separate items; capacities must be positive.
    """
    table = F.array(*[F.struct(F.lit(b).alias("budget_id"), F.lit(c).cast("long").alias("capacity")) for b, c in budgets])
    sized = items.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("size"), F.explode(table).alias("b")).select("doc_id", "size", "b.*")
    sized = sized.withColumn("full", F.when(F.col("size") > F.col("capacity"), F.floor(F.col("size") / F.col("capacity"))).otherwise(F.lit(0)).cast("int"))
    whole = (
        sized.where("full > 0")
        .select("*", F.explode(F.expr("sequence(0, full - 1)")).alias("piece_no"))
        .select("budget_id", "doc_id", "piece_no", (F.col("piece_no") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("n_tokens"), F.concat_ws("-", "budget_id", F.lit("d"), "doc_id", "piece_no").alias("container_id"))
    )
    rest = (
        sized.where("full = 0 or full * capacity < size")
        .select("budget_id", "doc_id", F.col("full").alias("piece_no"), (F.col("full") * F.col("capacity")).alias("start_token"), (F.col("size") - F.col("full") * F.col("capacity")).alias("n_tokens"), "capacity")
        .withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        at = pack(group["n_tokens"].to_numpy(), int(group["capacity"].iat[0]))
        group["container_id"] = [f"{b}-{s}-{c}" for b, s, c in zip(group["budget_id"], group["shard"], at)]
        return group[["budget_id", "doc_id", "piece_no", "start_token", "n_tokens", "container_id"]]

    kind = dict(items.dtypes)["doc_id"]
    packed = rest.groupBy("budget_id", "shard").applyInPandas(run, f"budget_id int, doc_id {kind}, piece_no int, start_token long, n_tokens long, container_id string")
    return whole.unionByName(packed)


def budget_list(budgets: DataFrame) -> list[tuple[int, int]]:
    """The rows of the small table of budgets; null and non-positive capacities are none."""
    return [(r["budget_id"], r["capacity"]) for r in budgets.where("capacity > 0").select("budget_id", "capacity").collect()]
