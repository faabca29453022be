"""The Merkle manifest against the definition, run by run."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import common, merkle_manifest, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, pos long, total long, digest string, group string, row_ long"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Many small jobs: few tasks each."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    yield
    spark.conf.set(key, before)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def brute(rows):
    """rows: dicts of documents -> {(doc_id, leaf): (subroot, root, proof, folded, verified)}"""
    def leaf(r, text):
        return H(*(field(r[c]) for c in ("doc_id", "source", "lang", "n_chars")), field(text))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i:i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    def siblings(tree, i):
        for nodes in tree[:-1]:
            lo = i // 8 * 8
            yield i - lo, nodes[lo:i] + nodes[i + 1:lo + 8]
            i //= 8
    langs = {}
    for r in rows:
        langs.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: (sorted(langs[k], key=lambda x: x[:3])) for k in order}
    lower = {k: levels([x[2] for x in trees[k]]) for k in order}
    upper = levels([lower[k][-1][0] for k in order])
    out = {}
    for at, k in enumerate(order):
        for i, (_, _, original, r) in enumerate(trees[k]):
            new, text = original, r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                new = leaf(r, None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
            steps = [*siblings(lower[k], i), *siblings(upper, at)]
            for slot, others in steps:
                new = H(*others[:slot], new, *others[slot:])
            out[r["doc_id"], original] = (lower[k][-1][0], upper[-1][0], H(*(x for _, o in steps for x in o)), new, new == upper[-1][0])
    return out


def run(spark, docs):
    scratch = common.Scratch(spark, "test-merkle")
    leaves = merkle_manifest.ordered_leaves(docs, queries.tampered_leaf(), scratch)
    return merkle_manifest.fold(merkle_manifest.build(leaves, scratch), scratch)


def compare(got, rows):
    got = got.collect()
    assert len(got) == len(rows)
    want = brute(rows)
    assert {(g.doc_id, g.leaf): (g.subroot, g.root, g.proof_sha256, g.folded_root, g.verified) for g in got} == want
    return got


def test_array_sha_equals_hashlib():
    rng = np.random.default_rng(1)
    nodes = rng.integers(0, 256, (37, 32)).astype(np.uint8)
    first, count = np.array([0, 8, 16, 30]), np.array([8, 1, 5, 7])
    made, kept = merkle_manifest.parents(nodes, first, count)
    for m, f, c, states in zip(made, first, count, kept):
        assert m.tobytes().hex() == H(*(nodes[i].tobytes().hex() for i in range(f, f + c)))
        for slot in range(c):  # every retained state goes on to the same digest
            again = merkle_manifest.refold(states[slot][None], nodes[f + slot][None], np.array([c]), np.array([c - slot - 1]),
                                           lambda live, t, at=f + slot: nodes[[at + 1 + t]])
            assert again.tobytes() == m.tobytes()


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 8, None: 9}, {"a": 513, "b": 1, "Z": 64, None: 3}, {"é": 4097, "z": 65}, {}])
def test_tree_by_definition(spark, sizes):
    rows, k = [], 0
    for lang, n in sizes.items():
        for i in range(n):
            k += 1
            rows.append(dict(doc_id=k * 7 % 10007 - 20, text=None if i % 11 == 5 else "" if i % 11 == 6 else f"Text Ü {i}\n", lang=lang,
                             source=None if i % 5 == 1 else "s:1", n_chars=None if i % 7 == 2 else i, pos=1, total=1, digest="x", group="g", row_=3))
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], DOCS)
    got = compare(run(spark, docs), rows)
    if len(rows) > 500:
        assert {g.verified for g in got} == {True, False}


def test_repeated_rows_null_ids_and_more_languages_than_a_page(spark):
    rows = [dict(doc_id=d, text=t, lang=f"l{i % 600}", source="s", n_chars=1, pos=1, total=1, digest="x", group="g", row_=3)
            for i, (d, t) in enumerate([(None, "A"), (None, "b"), (3, "C"), (3, "C"), (3, "D"), (5, "x" * 40_000)] + [(k, "Q") for k in range(9, 1300)])]
    rows += [dict(r) for r in rows[2:4]]
    got = run(spark, spark.createDataFrame([tuple(r.values()) for r in rows], DOCS)).collect()
    want = brute(rows)
    assert len(got) == len(rows) and {(g.doc_id, g.leaf) for g in got} == {*want}
    # equal rows stand beside one another, so only their proofs may differ
    assert all((g.subroot, g.root, g.verified) == (want[g.doc_id, g.leaf][0], want[g.doc_id, g.leaf][1], want[g.doc_id, g.leaf][4]) for g in got)


def test_query_on_given_documents(spark):
    rows = [r.asDict() for r in common.table(spark, SF, "documents").collect()]
    got = queries.op13_midstate_tree(spark, SF)
    assert dict(got.dtypes) == {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string",
                                "folded_root": "string", "verified": "boolean"}
    compare(got, rows)
    assert got.where(F.col("verified")).count() > 0
