"""The prefix trie against a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quarry.llm import common, prefix_trie, queries

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, conv long, pos long, depth long, node string, total long, n long"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Many small jobs: few tasks each."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    yield
    spark.conf.set(key, before)


def brute(rows):
    """rows (conv_id, turn, role, text) -> {(conv_id, depth): ...}"""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [x[2] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + v[h:])
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
            if d:
                kids[v[:d - 1]].add(v[:d])
        ends[v].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(m) - 1) * (len(node[-1][1]) if node else 0)
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items())


def result(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == cols
    return sorted(tuple(r) for r in df.collect())


def run(spark, rows):
    scratch = common.Scratch(spark, "test-trie")
    table = spark.createDataFrame([(*r, 1, 2, 3, "x", 4, 5) for r in rows], TURNS)
    return result(prefix_trie.build(*prefix_trie.rebuild(prefix_trie.turns(table, scratch), scratch), scratch))


def made(seed, n, longest, kinds):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(0, 3 * n), n):
        for t in range(r.randint(1, longest)):
            rows.append((c, None if t == 0 and c % 9 == 0 else t * 2, r.choice(["user", None, "assistant"]) if t % 3 == 2 else "user",
                         r.choice([None, "", "é日💡"] + [f"turn {k}" for k in range(kinds)])))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows", [made(1, 150, 7, 2), made(2, 60, 2, 1), made(3, 8, 40, 1) + [(300, t, "user", "same") for t in range(70)]])
def test_trie_by_definition(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_odd_tables(spark, monkeypatch):
    assert run(spark, []) == []
    # turnless conversations, many equal ones, a null conv_id, long texts; lists in several pieces
    monkeypatch.setattr(prefix_trie, "PIECE", 16)
    rows = [(c, 0, "user", "hello") for c in range(1, 100)] + [(None, 0, "user", "lost"), (205, 0, None, "x" * 50_000)]
    rows += [(c, t, "user", f"turn {t}") for c in range(400, 500) for t in range(9)]
    assert run(spark, rows) == brute(rows)
    repeated = [(7, 1, "user", "a")] * 3 + [(107, None, "user", "a"), (100, 5, "user", "b")]
    assert run(spark, repeated) == brute(repeated)


def test_query_on_given_conversations(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in common.table(spark, SF, "conversations").collect()]
    assert result(queries.op12_half_depth_trie(spark, SF)) == brute(rows)
