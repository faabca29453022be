"""The ten operators against brute force, round trips and held-out labels."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import (bpe, common, encoder, lattice_dedup, minhash_dedup, packing, pii, queries, quality_classifier, quality_rules,
                        records, token_counts, url_filters)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, key string"
ODD = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "1", "!", "É", "é", "́", "İ", "<|endoftext|>", "\x1c", "\xa0", "Σ", "日本", "　", "💡"]


def documents(spark, texts):
    """With clashing extra columns."""
    rows = [(i, t, "en" if i % 3 else None, "s", None if t is None else len(t), 0.5, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd_docs(spark):
    return documents(spark, [None, "", "  \n ", "one", "one two", "x" * 50_000, "7 " * 3000, "same words here again", "same words here again"])


def random_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 14))) for _ in range(n)]


# ---------------------------------------------------------------- 1

_BRUTE = (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
          re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_spans(text):
    def fits(kind, s):
        d = re.sub("[^0-9]", "", s)
        return (kind == 0 or kind == 1 and all(int(p) < 256 for p in s.split(".")) or kind == 2 and 13 <= len(d) <= 19 and pii.luhn(d)
                or kind == 3 and 9 <= len(d) <= 15)
    return [(k, *m.span()) for k, p in enumerate(_BRUTE) for m in p.finditer(text) if fits(k, m.group())]


def test_pii_base_spans_equal_the_plain_patterns():
    r = random.Random(1)
    for _ in range(5000):
        s = "".join(r.choice("a1@.+- (%2539.") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(s) == brute_spans(s)


def test_pii_decoding_is_the_best_segmentation():
    rng = np.random.default_rng(3)
    region = pii.Region("12.5 (a@7", 0, 9, [])
    w = rng.normal(size=(pii.O + 1, pii.N_FEATURES + 1))
    w[:, pii.N_FEATURES] = 0
    s = region.scores(w)

    def best(at):
        if at == region.n:
            return 0.0, []
        out = (-np.inf, [])
        for x, (i, j, _) in enumerate(region.segments):
            if i == at:
                rest, spans = best(j)
                y = int(np.argmax(s[x]))
                v = s[x, y] - (pii.MARGIN if y != pii.O else 0) + rest
                if v > out[0]:
                    out = v, ([(y, region.at[i], region.at[j])] if y != pii.O else []) + spans
        return out
    assert sorted(region.decode(w)) == sorted(best(0)[1])


def test_pii_keeps_base_spans_and_finds_disguised_ones(spark, odd_docs):
    texts = [f"call +1 (27{i % 10}) 555-{1000 + i} or joe.{i}@mail{i}.example.com from 10.2.3.{i} on line {i}" for i in range(120)]
    weights = pii.learn(documents(spark, texts))
    base, added = pii.find_spans("host 10[.]2[.]3[.]4 up", weights)
    assert base == [] and [k for k, _, _ in added] == [1]
    assert [r.base for r in pii.find(odd_docs, weights).orderBy("doc_id").collect()][:3] == [[], [], []]
    out = pii.redact(documents(spark, [texts[0], None]), weights).orderBy("doc_id").collect()
    assert out[0].text.startswith("call <PHONE> or <EMAIL> from <IP> on line") and out[0].n_chars == len(out[0].text) and out[1].text is None
    assert pii.learn(documents(spark, [])) is None and pii.find(documents(spark, []), None).count() == 0


def test_pii_finds_each_disguise_with_and_without_digits():
    hosts = ("example.com", "mail.example.org", "longcompanyname.example.com")
    texts = [f"write to {'joe' if i % 2 else 'jane.roe'}{i if i % 3 else ''}@{hosts[i % 3]} or call +1 (27{i % 10}) 555-{1000 + i} "
             f"from 10.2.3.{i} with card 4111 1111 1111 1111 on line {i} of {i * 7} pages" for i in range(60)]
    weights = pii.train([(t, pii.base_spans(t)) for t in texts])
    for kind, span in ((0, "john.doe [at] example.com"), (0, "john.doe[at]example.com"), (0, "john.doe (at) example.com"), (0, "john.doe(at)example.com"),
                       (0, "joe7 [at] longcompanyname.example.com"), (1, "10[.]2[.]3[.]4"), (2, "4111.1111.1111.1111"), (3, "001 (275) 555-1234")):
        text = f"please write to {span} or ask the long way round about it"
        at = text.index(span)
        assert any(lo <= at and at + len(span) <= hi for lo, hi in pii.regions(text, []))
        assert pii.find_spans(text, weights) == ([], [(kind, at, at + len(span))]), span


def test_pii_gold_spans_are_candidates():
    """Also those that are short, long or end inside a token."""
    for s in ("a@b.c", "éjoe@x-y.com", "x.y." * 12 + "z@a.example.com", "+1" + " 2" * 13):
        spans = pii.base_spans(s)
        region = pii.Region(s, 0, len(s), [], spans)
        for _, a, b in spans:
            assert (region.at.index(a), region.at.index(b)) in {x[:2] for x in region.segments[region.n:]}
        assert spans and pii.train([(s, spans)]) is not None


def test_pii_sample_holds_every_kind_however_rare():
    texts = [f"row {i} of {i * 31} numbers" for i in range(3000)]
    texts[1717] = "host 10.2.3.4 answers " + "1 2 3 " * 300
    texts[2020] = "mail joe@example.com"
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    rows = next(pii._sample_batches(iter([batch]))).to_pylist()
    assert Counter(r["class"] for r in rows) == {0: 1, 1: 1, pii.O: pii.SAMPLE_PLAIN}
    for r in rows:
        assert len(r["text"]) <= pii.PIECE and r["spans"][:1] == ([r["class"]] if r["class"] != pii.O else [])
        if r["spans"]:
            assert r["text"][slice(*r["spans"][1:])] in ("10.2.3.4", "joe@example.com")


# ---------------------------------------------------------------- 2

@pytest.mark.parametrize("window, n", [(2048, 600), (64, 900), (8, 40), (2048, 1), (2048, 0)])
def test_packer_covers_every_id_once_without_padding(window, n):
    r, packer, sizes, pieces = random.Random(n), packing.Packer(window), {}, []
    for k in range(n):
        sizes[k] = r.randint(1, 3 * window)
        pieces += packer.add(k, sizes[k])
    pieces += packer.finish()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for key, start, size, seq, offset in pieces:
        by_doc[key].append((start, size))
        by_seq[seq].append((offset, size))
    for spans in [*by_doc.values(), *by_seq.values()]:
        end = 0
        for at, size in sorted(spans):
            assert at == end and size > 0
            end += size
    assert {k: sum(s for _, s in v) for k, v in by_doc.items()} == sizes
    fill = [sum(s for _, s in v) for v in by_seq.values()]
    assert all(f <= window and (f == window or f & (f - 1) == 0) for f in fill)


def test_packer_chooses_the_least_sum_of_squares():
    r, packer = random.Random(9), packing.Packer(32)
    for _ in range(400):
        packer.levels[1:32] = [r.randint(0, 3) for _ in range(31)]
        size = r.randint(1, 31)

        def after(h):
            n = packer.levels.copy()
            if h:
                n[h] -= 1
            n[h + size] += h + size < 32
            return int((n[1:32] ** 2).sum())
        allowed = [h for h in range(32 - size + 1) if h == 0 or packer.levels[h]]
        assert after(packer.choose(size)) == min(map(after, allowed))


def test_packing_digests(spark, odd_docs):
    path = queries.tokenizer_path(queries.WORD_BPE)
    ids = encoder.Encoder(path).ids([r.text for r in odd_docs.orderBy("doc_id").collect()])
    rows = packing.pack(odd_docs, path, 1).collect()
    joined = defaultdict(bytes)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        joined[r.doc_id] += bytes(r.ids)
    assert [joined[i] for i in range(len(ids))] == [x + b"\1\0\0\0" for x in ids]


# ---------------------------------------------------------------- 3, 10 and the encoder

@pytest.mark.parametrize("name", [queries.WORD_BPE, queries.BYTE_BPE])
def test_ids_and_text_equal_the_library(name):
    from tokenizers import Tokenizer
    path = queries.tokenizer_path(name)
    library = Tokenizer.from_file(path)
    cached, own = encoder.Encoder(path), bpe.TransducingEncoder(path)
    r = random.Random(4)
    letters = [t for t in own.transducer.strings.values() if t.isalpha() and t.isascii()]
    long = ["".join(r.choice(letters) if r.random() < 0.8 else "ab"[i % 2] * r.randint(1, 30) for i in range(700)) for _ in range(12)]
    for text in random_texts(1500, 5) + long:
        ids = library.encode(text, add_special_tokens=False).ids
        raw = np.array(ids, dtype="<u4").tobytes()
        assert cached.ids([text]) == [raw] and own.ids([text]) == [raw]
        assert bpe.decode_ids(own.transducer, raw, r.randint(1, 5)) == library.decode(ids, skip_special_tokens=False)


def test_encode_decode_of_odd_rows(spark, odd_docs):
    path = queries.tokenizer_path(queries.WORD_BPE)
    rows = bpe.decode(bpe.encode(odd_docs, path), path).orderBy("doc_id").collect()
    assert len(rows) == 9 and bytes(rows[0].ids) == b"" and rows[0].text == "" and rows[7].ids == rows[8].ids


def test_edited_counts_equal_a_full_encoding():
    enc, r = encoder.Encoder(queries.tokenizer_path(queries.BYTE_BPE)), random.Random(2)
    for _ in range(80):
        doc = token_counts.Document("".join(r.choice(ODD) for _ in range(r.choice((0, 1, 5, 40, 900)))), enc)
        for _ in range(8):
            start, n, put = r.randint(0, len(doc.text) + 2), r.choice((0, 0, 1, 3, 50)), "".join(r.choice(ODD) for _ in range(r.choice((0, 1, 2, 200))))
            want = doc.text[:start] + put + doc.text[start + n:]
            doc.edit(start, n, put)
            assert doc.text == want and doc.n_tokens == len(enc.ids([want])[0]) // 4


def test_recount_of_tables(spark, odd_docs):
    edits = spark.createDataFrame([(4, 1, 3, 1, "XY"), (4, 2, 0, 3, None), (99, 1, 0, 0, "x"), (None, 1, 0, 0, "x"), (0, 1, 5, 5, "new text")],
                                  "doc_id long, seq long, start long, n_delete long, insert string")
    enc = encoder.Encoder(queries.tokenizer_path(queries.BYTE_BPE))
    rows = {r.doc_id: r for r in token_counts.recount(odd_docs, edits, queries.tokenizer_path(queries.BYTE_BPE)).collect()}
    assert len(rows) == 9 and rows[4].n_edits == 2 and rows[5].n_edits == 0
    assert rows[4].n_tokens == len(enc.ids(["XYtwo"])[0]) // 4 and rows[0].n_tokens == len(enc.ids(["new text"])[0]) // 4
    assert token_counts.recount(documents(spark, []), edits, queries.tokenizer_path(queries.BYTE_BPE)).count() == 0


# ---------------------------------------------------------------- 4

def test_redirects_share_verdicts(spark):
    link = '<link rel="canonical" href="{}">'.format
    pages = spark.createDataFrame([
        (1, "http://a.example.net/de/x", None), (2, "http://other.io/1", link("http://a.example.net/de/x#top")),
        (3, "http://third.io/2", '<meta http-equiv="refresh" content="0; url=http://other.io/1">'), (4, "http://alone.io/", "<p>"),
        (5, "http://m.example.net/en/", link("http://third.io/9")), (6, "http://third.io/9", link("//b.net/")), (7, None, link("http://b.net/")),
        (8, "no scheme", None), (9, "HTTP://WWW.Example.COM/de/a?q", None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filters.judge(pages).collect()}
    assert [got[i].verdict for i in range(1, 10)] == ["block", "block", "block", "allow", "allow", "allow", "allow", "allow", "block"]
    assert got[9].host == "www.example.com" and got[9].path == "/de/a" and got[9].rule == "example.com/de/" and got[8].host == got[7].path == ""


def test_redirect_targets_are_resolved_like_urljoin(spark):
    from urllib.parse import urljoin, urlsplit
    targets = ["next.html", "?page=1", "./a", "../b", "../../../c/./d/..", "/x/../y?q=../z", "//Other.org/p", "http://A.net/k#f", "a?u=http://x.org/", "sub/", "..", "#top"]
    pages, want = [], set()

    def node(u):
        s = urlsplit(u)
        return s.netloc.lower() + s.path + (f"?{s.query}" if s.query else "")
    for i, url in enumerate(["http://ex.com/d/e/f.html?k=1", "http://ex.com/d/e/", "http://Ex.com/top"]):
        for to in targets:
            pages.append((len(pages), url, f'<link href="{to}" rel="alternate canonical">'))
            want.add((node(url), node(urljoin(url, to))))
    # all tags of a page, words before and after, a base tag; no edge from other rel values and schemes
    pages.append((90, "http://m.com/a/b", "<LINK REL='canonical' href=c><link rel=canonical href=/d><meta http-equiv=refresh content='0;url=e'>"
                                          '<meta http-equiv="refresh" content="1; URL=f.html"><link rel="canonical nofollow" href="mailto:x@y.z">'
                                          '<link rel="canonicals" href="no"><link rel="next" href="no">'))
    want |= {("m.com/a/b", x) for x in ("m.com/a/c", "m.com/d", "m.com/a/e", "m.com/a/f.html")}
    pages.append((91, "http://b.com/a", '<base href="/deep/er/"><link rel="canonical" href="page">'))
    want.add(("b.com/a", "b.com/deep/er/page"))
    df = spark.createDataFrame(pages + [(92, None, "<link rel=canonical href=q>"), (93, "http://n.com/", None)], "page_id long, url string, html string")
    assert {(r.a, r.b) for r in url_filters.edges_of(df).collect()} == {(a, b) for a, b in want if a != b}
    df = spark.createDataFrame([(1, "http://ok.com/x/alias", '<link rel="alternate canonical" href="../de/p">'), (2, "http://example.com/t", '<meta http-equiv=refresh content="0;url=de/p">'),
                                (3, "http://ok.com/de/p", '<link rel=canonical href=q><link rel=canonical href="//example.com/de/p">')], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_filters.judge(df).collect()} == {1: "block", 2: "block", 3: "block"}


def test_components_of_chains_and_hubs(spark):
    r = random.Random(7)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(r.randint(2000, 2400), r.randint(2000, 2400)) for _ in range(250)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    out = common.connected_components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark, "t"), "cc").collect()
    touched = {x for e in edges if e[0] != e[1] for x in e}
    assert {r.node: r.component for r in out} == {x: find(x) for x in touched} and len(out) == len(touched)


# ---------------------------------------------------------------- 5, 6

def test_classifier_on_held_out_labels(spark):
    docs, labels = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    scored = queries.op5_attention_mil(spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id").collect()
    assert len(scored) > 40 and np.mean([r.predicted == r.quality for r in scored]) >= 0.95
    assert docs.count() == queries.op5_attention_mil(spark, "/root/testdata/sf0.01").count()


def test_classifier_gradients_and_odd_rows(spark, odd_docs):
    rng = np.random.default_rng(1)
    x, doc, y = rng.normal(size=(7, quality_classifier.N_FEATURES)), np.array([0, 0, 1, 1, 1, 2, 2]), np.array([1.0, 0.0, 1.0])
    first = np.array([0, 2, 5])
    w = quality_classifier.train([]) | {"a": rng.normal(size=8), "c": rng.normal(size=16)}
    loss = lambda w: float(-np.mean(np.log(np.where(y == 1, p := quality_classifier.forward(w, x, first, doc)["p"], 1 - p))))
    for k, g in quality_classifier.gradients(w, x, first, doc, y).items():
        step = rng.normal(size=np.shape(w[k])) * 1e-5
        assert loss(w | {k: w[k] + step}) - loss(w | {k: w[k] - step}) == pytest.approx(2 * float(np.sum(g * step)), rel=1e-3, abs=1e-11)
    scores = [r.quality_score_ for r in quality_classifier.score(odd_docs, w).collect()]
    assert len(scores) == 9 and all(0 <= s <= 1 for s in scores) and quality_classifier.score(documents(spark, []), w).count() == 0


def test_rule_statistics_by_definition():
    for text in ["", "a b", "a a a a a", "x y z\nx y z\n\nx y z", "q w e r q w e t #$|", *random_texts(300, 8)]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = Counter(zip(words, words[1:], words[2:]))
        again = {k for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(again))
        assert quality_rules.text_stats(text)[:5] == want


def test_rules_reject_outliers_and_keep_clean_documents(spark, odd_docs):
    rows = queries.op6_robust_outliers(spark, "/root/testdata/sf0.01").join(common.table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").collect()
    assert all(r.kept for r in rows if r.quality == 1 and not r.base_failed) and not any(r.kept for r in rows if r.quality == 0)
    assert [r.kept for r in quality_rules.judge(odd_docs).collect()] == [False] * 9
    assert quality_rules.filter_documents(documents(spark, [])).columns == documents(spark, []).columns


# ---------------------------------------------------------------- 7, 8

def test_lattice_links_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 64))
    x[100:160] = x[0] + rng.normal(size=(60, 64)) * 0.25         # a dense group
    x[200:230] = x[1] + rng.normal(size=(30, 64)) * 0.45          # around the threshold
    x[300:310] = x[2]                                            # copies
    vectors = [(i, v.astype("f4").tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 64), (502, [float("nan")] * 64), (503, []), (504, [1e-30] * 3)]
    got = {r.vec_id: r for r in lattice_dedup.components(spark.createDataFrame(vectors, "vec_id long, embedding array<float>")).collect()}
    u = x.astype("f4").astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(500, dtype=bool)
    assert sum(r.n_links for r in got.values()) >= 0.97 * near.sum() and all(got[i].n_links <= near[i].sum() for i in range(500))
    assert got[300].n_links == near[300].sum() and got[305].component_id == 2 and not got[305].kept
    assert all(got[i].n_links == 0 and got[i].kept for i in range(500, 505)) and len(got) == 505


def test_nearest_lattice_point():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 8))
    d, p = lattice_dedup.near_points(x, 4)
    assert all(float(v).is_integer() for v in p.sum(axis=2).ravel()) and (np.diff(d, axis=1) >= 0).all()
    # no minimal vector of E8 leads to a nearer point
    steps = [s for s in np.array(np.meshgrid(*[[-1, 0, 1]] * 8)).reshape(8, -1).T if np.abs(s).sum() == 2]
    steps += [s / 2 for s in np.array(np.meshgrid(*[[-1, 1]] * 8)).reshape(8, -1).T if s.sum() % 4 == 0]
    assert len(steps) == 240
    assert all((np.square(x - p[:, 0] - s).sum(axis=1) >= d[:, 0] - 1e-9).all() for s in steps)


def brute_components(texts, k, num, den):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    comp = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                lo, hi = sorted((comp[i], comp[j]))
                comp = [lo if c == hi else c for c in comp]
    return [len(s) for s in sets], comp


def test_min_max_components_against_all_pairs(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(5))
    texts = [None, "", "one two", "ONE two", " \n"]
    for _ in range(25):
        base = [word() for _ in range(r.randint(4, 120))]
        for _ in range(r.randint(1, 8)):
            texts.append(" ".join(w if r.random() > 0.02 else word() for w in base))
    hub = [word() for _ in range(80)]
    texts += [" ".join(w if r.random() > 0.012 else word() for w in hub) for _ in range(60)]
    for k, num, den in ((3, 85, 100), (5, 80, 100)):
        sizes, comp = brute_components(texts, k, num, den)
        rows = minhash_dedup.components(documents(spark, texts), k, num, den).orderBy("doc_id").collect()
        assert [x.n_shingles for x in rows] == sizes and [x.component_id for x in rows] == comp
        assert [x.kept for x in rows] == [c == i for i, c in enumerate(comp)]
    assert sorted(x.doc_id for x in minhash_dedup.filter_documents(documents(spark, texts), 5).collect()) == sorted(set(comp))
    assert minhash_dedup.components(documents(spark, [])).count() == 0


def test_repeated_rows_of_one_document_leave_one(spark):
    docs = documents(spark, ["a b c d e f g", "other words that are not alike at all"])
    assert minhash_dedup.filter_documents(docs.union(docs)).count() == 2


# ---------------------------------------------------------------- 9

def test_frames_round_trip_and_detect_damage():
    data = b"".join(records.frame(d, np.array(ids, "<u4").tobytes(), wide) for d, ids, wide in ((None, [2], False), (-5, [50256, 7], False), (9, [1 << 20], True)))
    assert [(d, np.frombuffer(i, "<u4").tolist()) for _, _, d, i in records.frames(data)] == [(None, [2]), (-5, [50256, 7]), (9, [1 << 20])]
    for at in range(0, len(data), 3):
        with pytest.raises(Exception):
            list(records.frames(data[:at] + bytes([data[at] ^ 4]) + data[at + 1:]))


def test_records_from_files(spark, odd_docs):
    path, scratch = queries.tokenizer_path(queries.BYTE_BPE), common.Scratch(spark, "records")
    docs = odd_docs.union(odd_docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    records.write(docs, f"{scratch.root}/shards", path, 2)
    index = records.write_index(spark, f"{scratch.root}/shards", f"{scratch.root}/index").orderBy("start").collect()
    texts = [None] + [r.text for r in odd_docs.orderBy("doc_id").collect()]
    ids = [x + b"\2\0\0\0" for x in encoder.Encoder(path).ids(texts)]
    assert [r.doc_id for r in index] == [None, *range(9)] and [r.ids_crc32 for r in index] == [zlib.crc32(x) for x in ids]
    assert [r.start for r in index] == [0, *np.cumsum([len(x) // 4 for x in ids])[:-1]]
    records.write(documents(spark, []), f"{scratch.root}/none", path, 2)
    assert records.write_index(spark, f"{scratch.root}/none", f"{scratch.root}/none-index").count() == 0


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages(spark):
    docs = common.table(spark, SF, "documents")
    scratch, columns = common.Scratch(spark, "pipeline-test"), docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = scratch.save(stage(spark, docs, SF), f"s{k}")
        if name != "packing":
            assert out.columns == columns
        if name == "MinHash near-dedup":
            texts = [r.text for r in docs.orderBy("doc_id").collect()]
            ids = [r.doc_id for r in docs.orderBy("doc_id").collect()]
            comp = brute_components(texts, 5, 80, 100)[1]
            assert sorted(r.doc_id for r in out.collect()) == [ids[c] for c in sorted(set(comp))]
        if name == "PII":
            assert out.count() == docs.count() and not any(brute_spans(r.text) for r in out.collect())
        if name == "packing":
            assert out.select("doc_id").distinct().count() == docs.count()
        docs = out


def test_stages_take_clashing_columns_null_ids_and_repeated_rows(spark):
    names = ["quality_score_", "row_key_", "bad_id_", "bad_key_", "gone_id_", "again_id_", "Quality_Score__", "kept", "distance", "rep", "comp", "spans", "ids"]
    given = common.table(spark, SF, "documents").withColumns({c: F.lit(7) for c in names})
    first = given.where("length(text) > 1500").orderBy("doc_id").first()
    nobody = given.where(F.col("doc_id") == first.doc_id).withColumn("doc_id", F.lit(None).cast("long"))
    empty = given.limit(2).withColumns({"text": F.lit(None).cast("string"), "doc_id": F.lit(-5).cast("long")})
    docs = given.unionByName(given.where(F.col("doc_id") == first.doc_id)).unionByName(nobody).unionByName(empty)
    scratch, columns = common.Scratch(spark, "pipeline-test"), docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = scratch.save(stage(spark, docs, SF), f"s{k}")
        if name != "packing":
            assert out.columns == columns and out.where("row_key_ = 7 and quality_score_ = 7 and gone_id_ = 7").count() == out.count() > 100
            assert out.where("doc_id is null").count() == 1 and out.where("doc_id = -5").count() == 0
            assert out.where(F.col("doc_id") == first.doc_id).count() == (2 if k < 2 else 1)
        docs = out


def test_prefix_rule_alone_finds_every_link(spark, monkeypatch):
    """Without pivot rounds all links come from the prefix rule."""
    monkeypatch.setattr(minhash_dedup, "PIVOT_ROUNDS", 0)
    rng = random.Random(11)
    base = [f"w{rng.randrange(400)}" for _ in range(90)]
    texts = []
    for i in range(60):
        words = list(base)
        for _ in range(i % 7):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 6)}"
        texts.append(" ".join(words[: 90 - i % 5]))
    sets = [{tuple(t.split()[i:i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    comp = list(range(len(texts)))
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in linked:
            comp[i] = comp[j] = min(comp[i], comp[j])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in minhash_dedup.components(df, 3, 85, 100).collect()}
    assert 1 < len(set(comp)) < len(texts)
    assert found == dict(enumerate(comp))


def test_pivot_rounds_without_new_pairs_do_not_skip_the_prefix_rule(spark):
    """Three texts whose shared buckets all hold the first one, which is the pivot of
    every round and links to neither: the other two still link by the prefix rule."""
    def bands(texts):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
        return [set(x) for x in next(minhash_dedup._batches(3)(iter([batch]))).column("bands").to_pylist()]
    for seed in range(2000):
        base = [f"w{seed}x{i}" for i in range(62)]
        changed = lambda at: " ".join(f"{w}{at[i]}" if i in at else w for i, w in enumerate(base))
        texts = [changed({20: "a", 50: "a"}), changed({}), changed({20: "b"})]
        first, x, y = bands(texts)
        if x & y and x & y <= first:
            break
    ids, rank = spark.range(2000), lambda d, r: F.xxhash64(F.col("id") + d, F.lit(r))
    for r in range(minhash_dedup.PIVOT_ROUNDS):
        ids = ids.where((rank(0, r) < rank(1, r)) & (rank(0, r) < rank(2, r)))
    least = ids.first().id
    df = spark.createDataFrame([(least + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id - least: r.component_id - least for r in minhash_dedup.components(df, 3, 85, 100).collect()}
    assert found == {0: 0, 1: 1, 2: 1}
