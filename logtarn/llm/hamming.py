"""Fingerprints within a few bits of each other, by a hierarchical index in Gray order.

Sorted by Gray rank, neighbours differ in few bits, so consecutive fingerprints share masked bit
patterns. An upper node holds the pattern that all fingerprints below it share. A search goes down
from the root, adds up the differences from the shared patterns, and drops a whole group as soon
as they exceed the bound.

The upper levels of the index are prefixes of the Gray rank and lie on Spark: each fingerprint
visits the prefixes it can still match, and prefixes with too many members are divided further.
The levels below a prefix are built and searched in numpy by one task per prefix. A fingerprint has
at most 1 + 64 + 64 * 63 / 2 others within two bits, so the links of a task stay in proportion to
its members however dense they lie; the task returns only a spanning forest of them.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtarn.llm.stored import stored

#: Fingerprints below a prefix, about; twice as many divide it further.
MEMBERS = 1024
#: Bits by which a prefix with too many members grows.
STEP = 4
FANOUT = 8
#: Steps of a search taken together; bounds a task's memory where fingerprints lie dense.
AT_ONCE = 1 << 16


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def build(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the root down: for each node the bits its codes share (mask) and their values.

    ``codes`` is in Gray order; a node of one level has FANOUT neighbours of the next below it.
    """
    every, any_ = codes, codes
    levels = [(np.full(len(codes), ~np.uint64(0)), codes)]
    while len(every) > 1:
        at = np.arange(0, len(every), FANOUT)
        every = np.bitwise_and.reduceat(every, at)
        any_ = np.bitwise_or.reduceat(any_, at)
        levels.append((~(every ^ any_), every))
    return levels[::-1]


def search(
    levels: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, allowed: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (query, place of a code) within the allowed bits, some at a time."""
    none = np.zeros(len(queries), np.int64)
    waiting = [(0, np.arange(len(queries)), none, none, none.astype(np.uint64))]
    while waiting:
        depth, *front = waiting.pop()
        if len(front[0]) > AT_ONCE:
            cuts = range(0, len(front[0]), AT_ONCE)
            waiting += [(depth, *(x[at : at + AT_ONCE] for x in front)) for at in cuts]
            continue
        query, node, spent, above = front
        mask, pattern = levels[depth]
        # Only bits that the parent doesn't share already add to the difference.
        new = mask[node] & ~above
        spent = spent + np.bitwise_count((queries[query] ^ pattern[node]) & new)
        alive = spent <= allowed
        query, node, spent = query[alive], node[alive], spent[alive]
        if depth + 1 == len(levels):
            yield query, node
        elif len(query):
            above = np.repeat(mask[node], FANOUT)
            below = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            real = below < len(levels[depth + 1][0])
            query, spent = np.repeat(query, FANOUT)[real], np.repeat(spent, FANOUT)[real]
            waiting.append((depth + 1, query, below[real], spent, above[real]))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the links a-b join, in a row through each component."""
    if not len(a):
        return a, b
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        while (after[after] != after).any():
            after = after[after]
        if (after == label).all():
            break
        label = after
    order = np.argsort(label, kind="stable")
    left, right = order[:-1], order[1:]
    same = label[left] == label[right]
    return nodes[left[same]], nodes[right[same]]


def _flips(bits: int, most: int):
    """Patterns of a number of bits with at most so many ones, as (pattern, ones)."""
    return [
        (sum(1 << k for k in chosen), n)
        for n in range(most + 1)
        for chosen in combinations(range(bits), n)
    ]


def _longer(visits: DataFrame, depth: int, bits: int, max_bits: int) -> DataFrame:
    """Each visit goes on to the prefixes, longer by some bits, that it can still match.

    Of two fingerprints with different prefixes only the one with the larger visits the other.
    """
    whole = F.shiftrightunsigned("fp", 64 - depth - bits)
    own = whole.bitwiseAND((1 << bits) - 1)
    flips = F.array(*[
        F.struct(F.lit(p).cast("long").alias("pattern"), F.lit(n).alias("ones"))
        for p, n in _flips(bits, max_bits)
    ])
    return (
        visits.withColumn("flip", F.explode(flips))
        .where(F.col("used") + F.col("flip.ones") <= max_bits)
        .select(
            "fp",
            F.shiftleft("prefix", bits).bitwiseOR(own.bitwiseXOR(F.col("flip.pattern"))).alias("prefix"),
            (F.col("used") + F.col("flip.ones")).alias("used"),
        )
        .where(F.col("prefix") <= whole)
    )


def links(fingerprints: DataFrame, max_bits: int) -> DataFrame:
    """Links ``a``, ``b`` that join all distinct fingerprints (column ``fp``) within ``max_bits``.

    Two fingerprints are in one component of these links if and only if a chain of fingerprints,
    each within ``max_bits`` of the next, joins them.
    """
    count = fingerprints.count()
    depth = max(0, (max(count, 1) // MEMBERS).bit_length())
    start = fingerprints.select("fp", F.lit(0).cast("long").alias("prefix"), F.lit(0).alias("used"))
    visits = stored(_longer(start, 0, depth, max_bits) if depth else start, "visits")
    found = None
    while True:
        # A fingerprint is a member of the one prefix that it visits without a difference.
        size = visits.where("used = 0").groupBy("prefix").count()
        large = size.where(F.col("count") > 2 * MEMBERS).select("prefix")
        last = depth + STEP > 60 or large.isEmpty()
        here = visits if last else visits.join(large, "prefix", "left_anti")
        edges = here.groupBy("prefix").applyInArrow(_search_in(max_bits), "a long, b long")
        found = edges if found is None else found.union(edges)
        if last:
            return found
        more = visits.join(large, "prefix", "left_semi").select("fp", "prefix", "used")
        visits = stored(_longer(more, depth, STEP, max_bits), "visits")
        depth += STEP


def _search_in(max_bits: int):
    def run(table: pa.Table) -> pa.Table:
        codes = table["fp"].to_numpy().view(np.uint64)
        used = table["used"].to_numpy().astype(np.int64)
        members = codes[used == 0]
        left, right = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        if len(members):
            members = members[np.argsort(gray_rank(members))]
            # The index sees whole codes, so it counts the bits of the prefix itself.
            for query, place in search(build(members), codes, max_bits):
                a, b = codes[query], members[place]
                a, b = forest(a[a != b], b[a != b])
                left.append(a)
                right.append(b)
        a, b = forest(np.concatenate(left), np.concatenate(right))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run
