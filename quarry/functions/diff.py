"""Aligned line differences of two texts (R2)."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs (sorted by the first number) whose second numbers rise."""
    tops, at, back = [], [], [0] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(tops, j)
        if n == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[n], at[n] = j, k
        back[k] = at[n - 1] if n else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _anchors(a: list[str], b: list[str], i: int, m: int, j: int, n: int) -> list[tuple[int, int]]:
    """Pairs of equal lines of a[i:m] and b[j:n] that may align: lines that
    stand once on both sides, or without such the k-th of a line with its k-th."""
    here, there = Counter(a[i:m]), Counter(b[j:n])
    once = {x for x, c in here.items() if c == 1 and there.get(x) == 1}
    left, right, seen_left, seen_right = {}, {}, Counter(), Counter()
    for k in range(i, m):
        if a[k] in there and (not once or a[k] in once):
            left[a[k], seen_left[a[k]]] = k
            seen_left[a[k]] += 1
    for k in range(j, n):
        if b[k] in here and (not once or b[k] in once):
            right[b[k], seen_right[b[k]]] = k
            seen_right[b[k]] += 1
    return _rising(sorted((k, right[x]) for x, k in left.items() if x in right))


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs (i, j) of lines that stay: common ends are taken off, the lines
    between meet at anchors, and the gaps between anchors in the same way."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i < m and j < n:
            anchors = _anchors(a, b, i, m, j, n)
            if anchors:
                out += anchors
                ends = [(i - 1, j - 1), *anchors, (m, n)]
                todo += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(ends, ends[1:])]
    return sorted(out)


def line_changes(old: str | None, new: str | None) -> dict:
    """Lines that stay, are moved, added and removed.  A line that is taken
    out in one place and put in in another is moved."""
    a, b = (old or "").split("\n"), (new or "").split("\n")
    kept = align(a, b)
    left, right = {i for i, _ in kept}, {j for _, j in kept}
    out, into = Counter(x for i, x in enumerate(a) if i not in left), Counter(x for j, x in enumerate(b) if j not in right)
    moved = sum((out & into).values())
    return {"same": len(kept), "moved": moved, "added": sum(into.values()) - moved, "removed": sum(out.values()) - moved}


CHANGES = T.StructType([T.StructField(c, T.LongType()) for c in ("same", "moved", "added", "removed")])


@F.pandas_udf(CHANGES)
def line_changes_udf(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([line_changes(x, y) for x, y in zip(old, new)], columns=["same", "moved", "added", "removed"])
