"""Splitters of a long key by iterated exact histograms, as DataFrame operations.

Each round every open splitter's interval of candidate boundaries gets evenly spaced probes. One aggregation counts
the exact weight and rows between neighbouring probes over all partitions; only these sums, one per probe, reach the
driver. An interval then shrinks to the two probes around its target, until the weight below one of them is within
tolerance or the interval holds a single key.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Boundaries counted in a pass, about: they are one expression and one row each on the driver.
MAX_BOUNDS = 1024


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are at most ``key``: a balanced tree of comparisons."""

    def tree(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        mid = (a + b) // 2
        return F.when(key < F.lit(bounds[mid]), tree(a, mid)).otherwise(tree(mid + 1, b))

    return tree(0, len(bounds))


@dataclass
class Histogram:
    """Exact weight and rows with a key below each bound."""

    bounds: list[int]
    weight: list[int]
    rows: list[int]


def count_below(rows: DataFrame, bounds: list[int]) -> Histogram:
    """One pass over ``rows(key long, weight long)``."""
    found = {r[0]: (r[1], r[2]) for r in rows.groupBy(bucket_of(F.col("key"), bounds).alias("bucket")).agg(F.sum("weight"), F.count("*")).collect()}
    weight, n, w_below, n_below = 0, 0, [], []
    for k in range(len(bounds)):
        more = found.get(k, (0, 0))
        weight, n = weight + (more[0] or 0), n + more[1]
        w_below.append(weight)
        n_below.append(n)
    return Histogram(bounds, w_below, n_below)


def _round_number(a: int, b: int) -> int:
    """The number in (a, b] with the most trailing zero bits."""
    for shift in range(63, -1, -1):
        if (number := b >> shift << shift) > a:
            return number
    return b


def splitters(rows: DataFrame, targets: list[int], tolerance: int, probes: int = 16) -> list[int]:
    """For each target a key below which the weight is the target, within ``tolerance`` where the keys allow it.

    Keys that share high bits stay on one side of a splitter where the tolerance leaves a choice. The weight below
    the result is the nearest there is if a single key weighs more than twice the tolerance.
    """
    intervals = [(LOW, HIGH)] * len(targets)  # of these boundaries, too little lies below the first, enough below the second
    chosen: dict[int, int] = {}
    below: dict[int, int] = {LOW: 0}
    while len(chosen) < len(targets):
        wanted = {b for _, b in intervals if b not in below}
        unsure = {interval for k, interval in enumerate(intervals) if k not in chosen}
        each = max(1, min(probes, MAX_BOUNDS // len(unsure)))
        for a, b in unsure:
            step = max(1, (b - a) // (each + 1))
            marks = [a + i * step for i in range(1, each + 1) if a + i * step < b]
            wanted |= {_round_number(p, q) for p, q in zip([a, *marks], marks, strict=False)}
        seen = count_below(rows, sorted(wanted))
        below |= dict(zip(seen.bounds, seen.weight, strict=True))
        known = sorted(below)
        for k, target in enumerate(targets):
            if k in chosen:
                continue
            weights = [below[b] for b in known]
            at = bisect_left(weights, target)  # the first boundary with enough below it
            near = [i for i in (at - 1, at) if 0 <= i < len(known) and abs(weights[i] - target) <= tolerance]
            if near:
                fit = [known[i] for i in range(bisect_left(weights, target - tolerance), bisect_right(weights, target + tolerance))]
                chosen[k] = max(fit, key=lambda b: ((b & -b).bit_length() if b else 65, -abs(below[b] - target)))
            elif at == len(known):
                chosen[k] = HIGH
            else:
                a, b = known[max(0, at - 1)], known[at]
                if b - a <= 1:
                    chosen[k] = min((a, b), key=lambda x: abs(below[x] - target))
                intervals[k] = (a, b)
    return [chosen[k] for k in range(len(targets))]


def kth_boundary(rows: DataFrame, k: int) -> int:
    """A boundary with exactly ``k`` keys below it where the keys differ; else the least with ``k`` or more."""
    (found,) = splitters(rows.select("key", F.lit(1).cast("long").alias("weight")), [k], 0, probes=64)
    return found
