import itertools
import random
import re

from quarry.operators import lineage as LN
from tests.conftest import files_df


def _words(n, rnd):
    vocab = [f"w{i}" for i in range(400)]
    return [rnd.choice(vocab) for _ in range(n)]


def test_near_copies_against_brute_force(spark):
    rnd = random.Random(7)
    base = [_words(300, rnd) for _ in range(6)]
    docs = {}
    for i, b in enumerate(base):
        docs[f"src/r/d{i}.go"] = " ".join(b)
        near = list(b)
        near[10] = "changed"                                  # one word changed: Jaccard ~0.97
        docs[f"src/r/d{i}_copy.go"] = " ".join(near)
    files = files_df(spark, sorted(docs.items()))
    got = {r["path"]: (r["representative"], r["similarity"]) for r in LN.near_copies(files, threshold=0.8).collect()}

    def grams(t):
        w = [x for x in re.split(r"[^\w]+|_", t.lower()) if x]
        return {" ".join(w[i:i + 5]) for i in range(max(len(w) - 4, 1))}

    g = {p: grams(t) for p, t in docs.items()}
    for a, b in itertools.combinations(sorted(docs), 2):
        jac = len(g[a] & g[b]) / len(g[a] | g[b])
        same = a in got and b in got and got[a][0] == got[b][0]
        if jac >= 0.9:
            assert same, (a, b, jac)
        if jac < 0.2:
            assert not same, (a, b, jac)


def test_near_copies_of_variant_families_have_every_link(spark):
    """Families of variants around a template: links between variants that the
    smallest path lacks, pairs near the threshold, exact copies."""
    rnd = random.Random(5)
    docs = {}
    for f in range(4):
        base = words = _words(120, rnd)
        for v in range(14):
            words = list(words if f % 2 else base)            # each from the one before, or all from the template
            for at in rnd.sample(range(len(words)), 1 if f % 2 else 1 + v % 2 + 2 * (v == 0)):
                words[at] = f"x{rnd.randrange(10 ** 6)}"
            docs[f"src/r/f{f}_{v:02d}.go"] = " ".join(words)
        docs[f"src/r/f{f}_copy.go"] = "  ".join(docs[f"src/r/f{f}_03.go"].split()).upper()
    docs["src/r/empty.go"] = " \n"
    got = {r["path"]: (r["representative"], r["similarity"]) for r in
           LN.near_copies(files_df(spark, sorted(docs.items())), threshold=0.8).collect()}
    g = {}
    for p, t in docs.items():
        w = [x for x in re.split(r"[^\w]+|_", t.lower()) if x]
        g[p] = {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    links = [(a, b) for a, b in itertools.combinations(sorted(docs), 2) if g[a] and 5 * len(g[a] & g[b]) >= 4 * len(g[a] | g[b])]
    comp = {p: p for p in docs}
    for _ in docs:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert any(5 * len(g[p] & g[c]) < 4 * len(g[p] | g[c]) for p, c in comp.items() if g[p])   # some link only by others
    want = {p: (comp[p], round(len(g[p] & g[comp[p]]) / len(g[p] | g[comp[p]]), 6)) for p in {x for link in links for x in link}}
    assert got == want


def test_call_chain_against_python_bfs(spark):
    rnd = random.Random(3)
    nodes = [f"n{i}" for i in range(40)]
    edges = {(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(90)}
    edf = spark.createDataFrame(sorted(edges), "caller string, callee string")
    roots = spark.createDataFrame([("n0",), ("n5",)], "root string")
    got = {(r["root"], r["node"]): r["depth"] for r in LN.call_chain(edf, roots, max_depth=4).collect()}
    want = {}
    for root in ("n0", "n5"):
        seen, frontier = {root: 0}, [root]
        for d in range(1, 5):
            nxt = sorted({c for (a, c) in edges if a in frontier} - set(seen))
            for n in nxt:
                seen[n] = d
            frontier = nxt
        want.update({(root, n): d for n, d in seen.items()})
    assert got == want


def test_snapshot_diff_and_changed_repos(spark):
    before = files_df(spark, [("src/a/x.go", "1"), ("src/a/y.go", "2"), ("src/b/z.go", "3")])
    after = files_df(spark, [("src/a/x.go", "1"), ("src/a/y.go", "22"), ("src/c/w.go", "4")])
    st = {r["path"]: r["status"] for r in LN.snapshot_diff(before, after).collect()}
    assert st == {"src/a/x.go": "same", "src/a/y.go": "modified", "src/b/z.go": "removed", "src/c/w.go": "added"}
    assert sorted(r["repo"] for r in LN.changed_repos(before, after).collect()) == ["a", "c"]


def test_exact_copies(spark):
    files = files_df(spark, [("src/r/a.py", "Hello   World\n"), ("src/r/b.py", "hello world"), ("src/r/c.py", "other")])
    got = {r["path"]: r["group_size"] for r in LN.exact_copies(files).collect()}
    assert got == {"src/r/a.py": 2, "src/r/b.py": 2}


def test_call_paths_are_shortest_chains(spark):
    import random
    rng = random.Random(11)
    pairs = {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(70)} | {(f"c{i}", f"c{i + 1}") for i in range(21)} | {("c21", "c3")}
    edges = spark.createDataFrame(sorted(pairs), "caller string, callee string")
    roots = spark.createDataFrame([("n1",), ("c0",), ("alone",)], "root string")
    got = {(r.root, r.node): (r.depth, list(r.path)) for r in LN.call_paths(edges, roots).collect()}
    for root in ("n1", "c0", "alone"):
        depth, level = {root: 0}, [root]
        while level:
            level = sorted({b for a, b in pairs if a in level and b not in depth})
            depth.update(dict.fromkeys(level, max(depth.values()) + 1))
        assert {n: d for (r, n), (d, _) in got.items() if r == root} == depth
        for node, d in depth.items():
            path = got[root, node][1]
            assert path[0] == root and path[-1] == node and len(path) == d + 1 and all(p in pairs for p in zip(path, path[1:]))
    assert max(d for d, _ in got.values()) == 21
    assert LN.call_paths(edges, roots.limit(0)).count() == 0 and LN.call_paths(edges.limit(0), roots).count() == 3
