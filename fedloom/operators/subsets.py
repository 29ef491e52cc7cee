"""The best subset of clients by branch and bound.

Both scores follow from distances alone: the variance summed over coordinates is the sum of a subset's squared
distances over the square of its size (where all clients have all coordinates), the other is its greatest distance.
They never fall as clients are added, so a beginning of a subset whose score, with the least that the missing clients
must add, is above the best one known needs no end.

The n x n distances are a table of bounded size (CLIENTS); beginnings of subsets, not subsets, are dealt to tasks. Each
task goes through what begins so in order, from the score of a greedy choice on; of equal scores (to EQUAL of their
size) the first subset counts. Subsets are never listed anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from ..plans.session import ship_package

CLIENTS = 1024
BEGINNINGS = 4096
EQUAL = 1e-12


def rank(chosen: list[int], n: int) -> int:
    """The place of a subset among all of its size, in the order of its members."""
    m, before, last = len(chosen), 0, -1
    for k, c in enumerate(chosen):
        before += sum(comb(n - 1 - x, m - 1 - k) for x in range(last + 1, c))
        last = c
    return before


def unrank(number: int, n: int, size: int) -> list[int]:
    """The subset of a place: what rank undoes."""
    out, c = [], 0
    while len(out) < size:
        behind = comb(n - 1 - c, size - 1 - len(out))
        if number < behind:
            out.append(c)
        else:
            number -= behind
        c += 1
    return out


class Search:
    """Best subsets of `size` rows of a matrix of distances (squared for variance)."""

    def __init__(self, d: np.ndarray, size: int, metric: str):
        self.d, self.n, self.size, self.largest = d, len(d), size, metric == "max_dist"

    def add(self, cost: float, reach: np.ndarray, c: int) -> tuple[float, np.ndarray]:
        """Cost with client c, and what each further client would add to it (or, for max_dist, make it)."""
        if self.largest:
            return max(cost, reach[c]), np.maximum(reach, self.d[c])
        return cost + reach[c], reach + self.d[c]

    def start(self) -> np.ndarray:
        return np.zeros(self.n)

    def greedy(self) -> float:
        """The cost without those clients that, one after the other, are farthest from all others left."""
        left = np.arange(self.n)
        while len(left) > self.size:
            sub = self.d[np.ix_(left, left)]
            left = np.delete(left, np.argmax(sub.max(1) + 1e-9 * sub.sum(1) if self.largest else sub.sum(1)))
        sub = self.d[np.ix_(left, left)]
        return float(sub.max() if self.largest else sub.sum() / 2)

    def beginnings(self) -> list[list[int]]:
        """In order; a subset's k-th member is one of the first n - size + k + 1."""
        spare, depth = self.n - self.size, 0
        while depth < self.size and comb(spare + depth + 1, depth + 1) <= BEGINNINGS:
            depth += 1
        return [list(x) for x in combinations(range(spare + depth), depth)] if depth else [[]]

    def best(self, beginning: list[int], most: float) -> tuple[float, list[int]] | None:
        """The first subset of least cost with this beginning, if that is no more than `most`."""
        cost, reach = 0.0, self.start()
        for c in beginning:
            cost, reach = self.add(cost, reach, c)
        found: tuple[float, list[int]] | None = None
        # a stack instead of recursion: subsets may have many members
        stack = [(cost, reach, list(beginning))]
        while stack:
            cost, reach, chosen = stack.pop()
            missing = self.size - len(chosen)
            if missing == 0:
                if cost <= most if found is None else cost < most * (1 - EQUAL):
                    found, most = (cost, chosen), cost
                continue
            first = chosen[-1] + 1 if chosen else 0
            rest = reach[first:]
            least = np.partition(rest, missing - 1)[:missing]
            bound = max(cost, float(least[-1])) if self.largest else cost + float(least.sum())
            if bound > most * (1 + EQUAL) or found is not None and bound >= most:
                continue
            for c in range(self.n - missing, first - 1, -1):
                new = self.add(cost, reach, c)
                if new[0] <= most * (1 + EQUAL):
                    stack.append((*new, [*chosen, c]))
        return found


def best_subset(spark: SparkSession, d: np.ndarray, size: int, metric: str) -> tuple[float, list[int]]:
    """(cost, members) of the first subset of least cost; d holds distances, squared for variance."""
    ship_package(spark)
    search = Search(d, size, metric)
    most = search.greedy() * (1 + 1e-9)
    begin = search.beginnings()
    shared = spark.sparkContext.broadcast((search, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, most = shared.value
        for batch in batches:
            rows = []
            # within a task later beginnings are measured by what earlier ones gave
            for number, chosen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = search.best(chosen, most)
                if found:
                    rows.append((number, *found))
                    most = min(most, found[0])
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.list_(pa.int32()))], names=["number", "cost", "members"])

    parts = min(len(begin), 4 * spark.sparkContext.defaultParallelism)
    table = spark.createDataFrame(list(enumerate(begin)), "number int, chosen array<int>").repartition(parts, "number")
    found = table.mapInArrow(run, "number int, cost double, members array<int>").collect()  # a row for each beginning at most
    shared.destroy()
    least = min(r["cost"] for r in found)
    first = min((r for r in found if r["cost"] <= least * (1 + EQUAL)), key=lambda r: r["number"])
    return first["cost"], list(first["members"])
