"""Similarity of two texts by their longest matching blocks.

The ratio is 2 * matched / (both lengths).  Matched are the characters of the longest common
block (earliest in the first text, then in the second), and of the longest ones to the left
and to the right of it, and so on.  In a second text of 200 and more characters a character
that makes up more than a hundredth of it starts no block, it only prolongs one.

A block is found by a suffix automaton of the stretch of the second text at hand, read once
by the stretch of the first: time and memory are linear in the two stretches, also where
one character repeats all along.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG_TEXT = 200
COMMON_SHARE = 100


def common_characters(text: str) -> frozenset[str]:
    """Characters too common in a long text to start a block."""
    if len(text) < LONG_TEXT:
        return frozenset()
    return frozenset(c for c, n in Counter(text).items() if n > len(text) // COMMON_SHARE + 1)


def _automaton(text: str, lo: int, hi: int, common: frozenset[str]) -> tuple[list[dict], list[int], list[int], list[int]]:
    """Suffix automaton of ``text[lo:hi]``: steps, suffix links, lengths and the first end of each state.

    A common character stands as its own place, a symbol that meets nothing.
    """
    steps, link, size, end = [{}], [-1], [0], [lo - 1]
    last = 0
    for place in range(lo, hi):
        symbol = place if text[place] in common else text[place]
        new = len(steps)
        steps.append({})
        link.append(0)
        size.append(size[last] + 1)
        end.append(place)
        at = last
        while at >= 0 and symbol not in steps[at]:
            steps[at][symbol] = new
            at = link[at]
        if at >= 0:
            to = steps[at][symbol]
            if size[to] != size[at] + 1:
                copy = len(steps)
                steps.append(dict(steps[to]))
                link.append(link[to])
                size.append(size[at] + 1)
                end.append(end[to])
                link[to] = copy
                while at >= 0 and steps[at].get(symbol) == to:
                    steps[at][symbol] = copy
                    at = link[at]
                to = copy
            link[new] = to
        last = new
    return steps, link, size, end


def _longest(a: str, b: str, a0: int, a1: int, b0: int, b1: int, common: frozenset[str]) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest block of ``a[a0:a1]`` and ``b[b0:b1]``."""
    steps, link, size, end = _automaton(b, b0, b1, common)
    state = held = best = 0
    i, j = a0, b0
    for place in range(a0, a1):
        symbol = a[place]
        while state and symbol not in steps[state]:
            state = link[state]
            held = size[state]
        if symbol in steps[state]:
            state = steps[state][symbol]
            held += 1
            if held > best:
                best, i, j = held, place - held + 1, end[state] - held + 1
    stop_a, stop_b = i + best, j + best
    while i > a0 and j > b0 and a[i - 1] == b[j - 1]:
        i, j = i - 1, j - 1
    while stop_a < a1 and stop_b < b1 and a[stop_a] == b[stop_b]:
        stop_a, stop_b = stop_a + 1, stop_b + 1
    return i, j, stop_a - i


def block_ratio(a: str, b: str) -> float:
    """Share of the characters of both texts that lie in matching blocks; 1 for two empty texts."""
    if a == b:
        return 1.0
    common = common_characters(b)
    matched, open_ = 0, [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        if a0 == a1 or b0 == b1:
            continue
        i, j, n = _longest(a, b, a0, a1, b0, b1, common)
        if n:
            matched += n
            open_ += [(a0, i, b0, j), (i + n, a1, j + n, b1)]
    return 2.0 * matched / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def block_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """``block_ratio`` of two columns; null where one is null."""
    return pd.Series([None if x is None or y is None else block_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
