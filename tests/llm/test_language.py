"""PPM language identification against a plain context tree, byte by byte."""

import random
from collections import Counter, defaultdict
from fractions import Fraction
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.llm import common, language_ppm, queries
from quarry.llm.language_ppm import ORDER

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, draw long, score double, spoken boolean, n long"


class Plain:
    """Counts by context; probabilities as fractions."""

    def __init__(self, texts, least=1):
        seen = Counter()
        for t in texts:
            b = b"\n" * ORDER + t.encode()
            seen.update(b[i - k:i + 1] for i in range(ORDER, len(b)) for k in range(ORDER + 1))
        self.after = defaultdict(dict)
        for s, n in seen.items():
            if n >= least:
                self.after[s[:-1]][s[-1]] = n

    def probability(self, context, byte):
        p, out = Fraction(1), set()
        for k in range(ORDER, -1, -1):
            here = {b: n for b, n in self.after.get(context[ORDER - k:], {}).items() if b not in out}
            room = sum(here.values()) + len(here)
            if byte in here:
                return p * Fraction(here[byte], room)
            if here:
                p *= Fraction(len(here), room)
            out |= {*self.after.get(context[ORDER - k:], {})}
        return p / (256 - len(out))

    def bits(self, text):
        b = b"\n" * ORDER + text.encode()
        return sum(-log2(self.probability(b[i - ORDER:i], b[i])) for i in range(ORDER, len(b)))


def tree(plain):
    by = [defaultdict(int) for _ in range(ORDER + 1)]
    for c, after in plain.after.items():
        for b, n in after.items():
            by[len(c)][int.from_bytes(c + bytes([b]), "big")] = n
    return language_ppm.Tree([(np.array([*x], dtype=np.int64), np.array([*x.values()], dtype=np.int64)) for x in by])


def sample(seed, letters, n=60):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_code_lengths_equal_a_plain_tree():
    kinds = {"a": (sample(1, "ab ü\n"), 1), "b": (sample(2, "bcdé x"), 3), "c": (sample(3, "abcd\n日"), 40)}
    plain = {k: Plain(*v) for k, v in kinds.items()}
    assert abs(sum(plain["b"].probability(b"bc ", x) for x in range(256)) - 1) == 0   # a proper distribution
    model = language_ppm.Model([*kinds], [0.5, 0.25, 0.25], [tree(p) for p in plain.values()])
    texts = ["", "a", "ab", "\n\n", "日本 b", "q" * 50, *sample(4, "abcdé ü日\n", 40)]
    got = model.lengths(*common.text_buffers(pa.array(texts)))
    for t, row in zip(texts, got):
        for k, units in zip(kinds, row):
            assert abs(units / language_ppm.UNIT - plain[k].bits(t)) <= len(t.encode()) / language_ppm.UNIT


def test_batches_and_slices_do_not_change_lengths(monkeypatch):
    texts = [None, "", *sample(5, "ab c", 30), "ab c" * 900, "", "x"]
    model = language_ppm.Model(["a"], [1.0], [tree(Plain(sample(6, "abc ")))])
    whole = model.lengths(*common.text_buffers(pa.array(texts)))
    monkeypatch.setattr(language_ppm, "SLICE", 64)
    assert (model.lengths(*common.text_buffers(pa.array(texts))) == whole).all()
    alone = [model.lengths(*common.text_buffers(pa.array([t], pa.string())))[0] for t in texts]
    assert (np.array(alone) == whole).all()


def rows(spark, texts):
    return spark.createDataFrame([(i, t, lang, "s", 1, 0.5, True, 3) for i, (t, lang) in enumerate(texts)], DOCS)


def test_learned_model_and_odd_rows(spark):
    texts = [(t, "l1") for t in sample(7, "abc d", 50)] + [(t, "l2") for t in sample(8, "efg h", 50)] + [("zzz", None)]
    model = language_ppm.learn(rows(spark, texts), F.lit(True))
    assert model.langs == ["l1", "l2"]
    kept = {k: Plain({t for t, lang in texts if lang == k}) for k in model.langs}
    for k, t in zip(model.langs, model.trees):
        want = tree(kept[k])
        assert all((t.seq[i] == want.seq[i]).all() and (t.n[i] == want.n[i]).all() for i in range(ORDER + 1))
    odd = [(None, "l1"), ("", "l1"), (" 12 !\n", None), ("abca", None), ("hgfe" * 20_000, None), ("abca", "l2"), ("é", None)]
    got = language_ppm.predict(rows(spark, odd), model).orderBy("doc_id").collect()
    assert [g.lang_pred for g in got][:6] == ["und", "und", "und", "l1", "l2", "l1"] and got[6].lang_pred in model.langs
    assert all(g.score == 0 for g in got[:3]) and all(0.5 <= g.score <= 1 for g in got[3:])


def test_ties_take_the_smallest_name_and_nothing_learned_is_und(spark):
    same = sample(9, "ab ", 30)
    model = language_ppm.learn(rows(spark, [(t, k) for k in ("y", "x") for t in same]), F.lit(True))
    got = language_ppm.predict(rows(spark, [("ab ba", None)]), model).first()
    assert (got.lang_pred, got.score) == ("x", 0.5)
    assert language_ppm.learn(rows(spark, []), F.lit(True)) is None
    assert language_ppm.learn(rows(spark, [("a", None), (None, "x"), ("", "x")]), F.lit(True)) is None
    assert language_ppm.predict(rows(spark, [("ab", "x")]), None).first().lang_pred == "und"
    assert language_ppm.predict(rows(spark, []), model).count() == 0


def test_contexts_kept_are_bounded_and_closed(spark, monkeypatch):
    monkeypatch.setattr(language_ppm, "MOST_SEQUENCES", 200)
    model = language_ppm.learn(rows(spark, [(t, k) for k in ("x", "y") for t in sample(k, "abcdefgh ", 60)]), F.lit(True))
    for t in model.trees:
        assert 0 < sum(map(len, t.seq)) <= 100
        for k in range(1, ORDER + 1):
            assert np.isin(t.seq[k] & np.uint64((1 << 8 * k) - 1), t.seq[k - 1]).all()


def test_query_on_given_documents(spark):
    got = {r.doc_id: r for r in queries.op11_partial_matching(spark, SF).collect()}
    docs = common.table(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if got[d.doc_id].held_out]
    assert held and sum(got[d.doc_id].lang_pred == d.lang for d in held) >= 0.99 * len(held)
    learned = defaultdict(set)
    for d in docs:
        if not got[d.doc_id].held_out and d.lang is not None and d.text:
            learned[d.lang].add(d.text)
    share = Counter(d.lang for d in docs if not got[d.doc_id].held_out and d.lang is not None and d.text)
    plain = {k: Plain(v) for k, v in learned.items()}
    for d in sorted(held, key=lambda x: len(x.text or ""))[:25]:
        bits = {k: p.bits(d.text) - log2(share[k] / sum(share.values())) for k, p in plain.items()}
        best = min(bits, key=bits.get)
        assert got[d.doc_id].lang_pred == best
        assert abs(got[d.doc_id].score - 1 / sum(2.0 ** (bits[best] - x) for x in bits.values())) < 0.01
