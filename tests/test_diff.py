"""Aligned differences against exhaustive alignments of small files."""

import random
from functools import lru_cache

from quarry.functions import diff as D


def longest(a, b):
    @lru_cache(None)
    def best(i, j):
        if i == len(a) or j == len(b):
            return 0
        return max(best(i + 1, j), best(i, j + 1), best(i + 1, j + 1) + 1 if a[i] == b[j] else 0)
    return best(0, 0)


def check(a, b):
    pairs = D.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    return len(pairs)


def test_alignment_of_distinct_lines_is_longest():
    r = random.Random(1)
    for _ in range(300):
        a = r.sample("abcdefghijkl", r.randint(0, 10))
        b = r.sample("abcdefghijkl", r.randint(0, 10))
        assert check(tuple(a), tuple(b)) == longest(tuple(a), tuple(b))


def test_alignment_of_repeated_lines():
    r = random.Random(2)
    near = 0
    for _ in range(300):
        a = tuple(r.choice("abcd") for _ in range(r.randint(0, 9)))
        b = tuple(r.choice("abcd") for _ in range(r.randint(0, 9)))
        n, most = check(a, b), longest(a, b)
        assert n <= most and (n > 0) == (most > 0)
        near += n == most
    assert near > 200 and check(("x",) * 500, ("x",) * 300) == 300


def test_changes_apart():
    old = "a\nb\nc\nd\ne"
    assert D.line_changes(old, old) == {"same": 5, "moved": 0, "added": 0, "removed": 0}
    assert D.line_changes(old, "b\nc\nd\ne\na") == {"same": 4, "moved": 1, "added": 0, "removed": 0}
    assert D.line_changes(old, "a\nx\nc\ny\nd") == {"same": 3, "moved": 0, "added": 2, "removed": 2}
    assert D.line_changes(None, "a") == {"same": 0, "moved": 0, "added": 1, "removed": 1}
    r = random.Random(3)
    for _ in range(200):
        a, b = ("\n".join(r.choice("abcde") for _ in range(r.randint(1, 12))) for _ in range(2))
        c = D.line_changes(a, b)
        assert c["same"] + c["moved"] + c["removed"] == a.count("\n") + 1 and c["same"] + c["moved"] + c["added"] == b.count("\n") + 1


def test_registered_query_keeps_every_line(spark):
    from quarry.plans.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    plain = {r.path: r for r in QUERIES["r2_drift_audit"](spark, sf).collect()}
    aligned = {r.path: r for r in QUERIES["r2_aligned_diff"](spark, sf).collect()}
    assert aligned.keys() == plain.keys() and any(r.added for r in aligned.values())
    for p, r in aligned.items():
        assert r.same + r.moved + r.added == plain[p].n_lines and r.added == plain[p].changed_lines
