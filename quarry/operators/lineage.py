"""Snapshots, change detection, call chains and copy detection.

R1/D8 compare two versions of ``files`` by (path, sha) only, so file
contents never travel.  R3 walks an edge table breadth-first with one join and
one reliable checkpoint per level, until no node is new.  R4 finds exact copies by a
normalised hash and near copies by MinHash bands, with links confirmed on the
whole shingle sets and components over links, never all pairs of a bucket.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.joins import join_small
from quarry.session import cut_lineage


# ------------------------------------------------------------------------ R1

def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Path, status (added / removed / modified / same), both shas."""
    b = before.select("path", F.col("sha").alias("sha_before"))
    a = after.select("path", F.col("sha").alias("sha_after"))
    j = b.join(a, "path", "full_outer")
    status = (F.when(F.col("sha_before").isNull(), "added")
              .when(F.col("sha_after").isNull(), "removed")
              .when(F.col("sha_before") != F.col("sha_after"), "modified")
              .otherwise("same"))
    return j.select("path", status.alias("status"), "sha_before", "sha_after")


def changed_repos(before: DataFrame, after: DataFrame) -> DataFrame:
    """Repositories of ``after`` (repo, n_files) in which a file came, went
    or holds other bytes than in ``before`` (new repositories included);
    compared file by file on (repo, path, full sha)."""
    key = ["repo", "path", "sha"]
    b, a = before.select(key), after.select(key)
    changed = a.join(b, key, "left_anti").union(b.join(a, key, "left_anti")).select("repo").distinct()
    counts = after.groupBy("repo").agg(F.count(F.lit(1)).alias("n_files"))
    return counts.join(changed, "repo", "left_semi")


# ------------------------------------------------------------------------ R3

CALL_EDGE_RE = r"(?:func|def|int) (\w+)\([^)]*\)[^\n]*\n\s*return (\w+)\(x\)"


def call_edges(files: DataFrame) -> DataFrame:
    """caller -> callee edges of the generated code view (distinct)."""
    c = F.col("content")
    pairs = F.arrays_zip(F.regexp_extract_all(c, F.lit(CALL_EDGE_RE), 1).alias("caller"),
                         F.regexp_extract_all(c, F.lit(CALL_EDGE_RE), 2).alias("callee"))
    return (files.select(F.explode(pairs).alias("e"))
            .select(F.col("e.caller").alias("caller"), F.col("e.callee").alias("callee")).distinct())


#: Levels after which the visited nodes are written as one table again.
FOLD_LEVELS = 16


def call_chain(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Every node reachable from each root, with its BFS depth; walks until
    a level brings no new node (or to ``max_depth`` edges where one is given).
    ``roots(root)``, ``edges(caller, callee)``.  The edge table is materialised
    once; each level is a table of its own and earlier levels are not rewritten
    but every ``FOLD_LEVELS`` levels, which bounds the plan."""
    e = cut_lineage(edges.select("caller", "callee").distinct())
    frontier = cut_lineage(roots.select("root", F.col("root").alias("node")).distinct())
    visited = frontier.withColumn("depth", F.lit(0))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = (frontier.join(e, frontier["node"] == e["caller"])
                .select("root", F.col("callee").alias("node")).distinct()
                .join(visited.select("root", "node"), ["root", "node"], "left_anti"))
        frontier = cut_lineage(step)
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier.withColumn("depth", F.lit(depth)))
        if depth % FOLD_LEVELS == 0:
            visited = cut_lineage(visited)
    return visited


def call_paths(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """R3 with its witness: (root, node, depth, path) of every reachable node,
    ``path`` one shortest chain of names from the root to it.

    Every node points to its least caller one level nearer the root.  The
    pointers form a tree, and paths are put together by pointer doubling: in
    each round a node takes over the piece of path its pointer has and that
    one's pointer, so a chain of length d is whole after log2(d) rounds."""
    e = cut_lineage(edges.select("caller", "callee").distinct())
    seen = cut_lineage(call_chain(e, roots, max_depth))
    before = seen.select("root", F.col("node").alias("caller"), (F.col("depth") + 1).alias("depth"))
    towards = (before.join(e, "caller").select("root", F.col("callee").alias("node"), "depth", "caller")
               .groupBy("root", "node", "depth").agg(F.min("caller").alias("pointer")))
    cur = seen.join(towards, ["root", "node", "depth"], "left").select("root", "node", "depth", "pointer", F.array("node").alias("path"))
    deepest = seen.agg(F.max("depth")).first()[0] or 0
    for _ in range(int(deepest).bit_length()):
        cur = cut_lineage(cur)
        ahead = cur.select("root", F.col("node").alias("pointer"), F.col("pointer").alias("next"), F.col("path").alias("front"))
        cur = cur.join(ahead, ["root", "pointer"], "left").select(
            "root", "node", "depth", F.col("next").alias("pointer"), F.when(F.col("front").isNull(), F.col("path")).otherwise(F.concat("front", "path")).alias("path"))
    return cur.select("root", "node", "depth", "path")


# ------------------------------------------------------------------------ R4

def normalised(content) -> F.Column:
    c = F.col(content) if isinstance(content, str) else content
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def exact_copies(files: DataFrame) -> DataFrame:
    """R4 exact: files whose normalised text is shared with another file;
    (path, group_hash, group_size)."""
    h = files.select("path", F.md5(normalised("content")).alias("group_hash"))
    sizes = h.groupBy("group_hash").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    return h.join(sizes, "group_hash").select("path", "group_hash", "group_size")


def _minhash_params(num_hashes: int, seed: int = 42):
    import numpy as np
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, size=num_hashes, dtype=np.uint64)
    b = rng.integers(0, 2**63, size=num_hashes, dtype=np.uint64) | np.uint64(1)
    return a, b


_GRAM_MULT = 1_099_511_628_211  # odd 64-bit multiplier for rolling n-gram hashes


def gram_hashes(text: str, shingle: int):
    """Sorted distinct 64-bit hashes of the word ``shingle``-grams of one text
    (a shorter text is one gram), None without words; all in numpy: word hashes
    by pandas' C hasher, n-gram hashes by a rolling combination."""
    import re

    import numpy as np
    words = [w for w in re.split(r"[^\w]+|_", text.lower()) if w]
    if not words:
        return None
    wh = pd.util.hash_pandas_object(pd.Series(words, dtype=object), index=False).to_numpy(dtype=np.uint64)
    n = max(len(wh) - shingle + 1, 1)
    g = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(shingle, len(wh))):
            g = g * np.uint64(_GRAM_MULT) + wh[j:j + n]
    return np.unique(g)


def _minima(g, a, b) -> list[int]:
    """MinHash of a gram set: the least of each permutation ``((g ^ a_i) * b_i) mod 2**64``."""
    import numpy as np
    with np.errstate(over="ignore"):
        v = (g[:, None] ^ a) * b
    return v.min(axis=0).astype(np.int64).tolist()


def minhash_signatures(files: DataFrame, shingle: int = 5, num_hashes: int = 64) -> DataFrame:
    """Per file with words: path, n (distinct word ``shingle``-grams), set_id
    (128-bit identity of the gram set) and its MinHash signature (Arrow-batched
    UDF; one pass over each text, numpy for the permutations)."""
    a, b = _minhash_params(num_hashes)

    @F.pandas_udf("n long, set_id binary, sig array<long>")
    def profile_udf(content: pd.Series) -> pd.DataFrame:
        from hashlib import md5
        sets = [None if t is None else gram_hashes(t, shingle) for t in content]
        return pd.DataFrame({"n": [0 if g is None else len(g) for g in sets],
                             "set_id": [None if g is None else md5(g.tobytes()).digest() for g in sets],
                             "sig": [None if g is None else _minima(g, a, b) for g in sets]})

    return files.select("path", profile_udf.asNondeterministic()("content").alias("p")).select("path", "p.*").filter("n > 0")


def _grams(files: DataFrame, shingle: int) -> DataFrame:
    """(rep, grams): the whole gram set of each file."""
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def grams_udf(content: pd.Series) -> pd.Series:
        return content.map(lambda t: gram_hashes(t, shingle).view("int64"))

    return files.select(F.col("path").alias("rep"), grams_udf("content").alias("grams"))


def _components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b): the smallest node
    reachable, by alternating large-star and small-star steps."""
    cur, last = edges.select("a", "b").filter("a <> b"), None
    while True:
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = cut_lineage(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        cur = cut_lineage(small.select("e.a", "e.b").filter("a <> b").distinct())
        mark = cur.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (mark.n, mark.s) == last:
            break
        last = (mark.n, mark.s)
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


#: Slots of the sketches that tell gram sets apart before they are compared.
PARITY_BITS = 1024


@F.pandas_udf(T.ArrayType(T.LongType()))
def parity_udf(grams: pd.Series) -> pd.Series:
    """The parity of a set's grams in each of PARITY_BITS slots, as 64-bit words."""
    import numpy as np

    def one(g):
        with np.errstate(over="ignore"):
            slot = (np.asarray(g, dtype=np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PARITY_BITS.bit_length() + 1)
        return np.packbits(np.bincount(slot.astype(np.int64), minlength=PARITY_BITS).astype(np.uint8) & 1).view(np.int64)
    return grams.map(one)


def _rarest_shared(rest: DataFrame, grams: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (x, y) of ``rest`` (rep, comp) across components that may link: with
    the grams of every set in ascending order of frequency, sets of sizes m and n
    that link share ``need = ceil(num * (m + n) / (num + den))`` of them, so the
    first shared one comes before the last ``need`` of both; and their parity
    sketches differ in at most the ``m + n - 2 need`` grams that one set only may
    have.  Both bounds are exact."""
    rows = cut_lineage(rest.join(grams, "rep").select("rep", "comp", F.size("grams").cast("long").alias("n"), F.explode("grams").alias("h")))
    often = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("df > 1")
    one = Window.partitionBy("rep")
    # grams that no other set has come first in the order and need no row, only their number
    place = F.col("n") - F.count(F.lit(1)).over(one) + F.row_number().over(one.orderBy("df", "h"))
    first = (rows.join(often, "h").withColumn("place", place)
             .filter(f"lo <> hi and place <= n - ({num} * n + {den - 1}) div {den} + 1"))
    sketches = rest.select("rep").join(grams, "rep").select("rep", parity_udf("grams").alias("bits"))
    first = cut_lineage(first.select("h", "rep", "comp", "n", "place").join(sketches, "rep"))
    x, y = (first.select("h", F.col("rep").alias(s), F.col("comp").alias(f"c{s}"), F.col("n").alias(f"n{s}"), F.col("place").alias(f"p{s}"),
                         F.col("bits").alias(f"b{s}")) for s in "xy")
    need = f"({num} * (nx + ny) + {num + den - 1}) div {num + den}"
    apart = sum((F.bit_count(F.col("bx")[i].bitwiseXOR(F.col("by")[i])) for i in range(PARITY_BITS // 64)), F.lit(0))
    return (x.join(y, "h").filter(f"x < y and cx <> cy and px + {need} <= nx + 1 and py + {need} <= ny + 1")
            .filter(apart <= F.expr(f"nx + ny - 2 * ({need})")).select("x", "y"))


def _shared(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """(x, y, both, union): sizes on the whole gram sets of each pair."""
    gx, gy = grams.toDF("x", "gx"), grams.toDF("y", "gy")
    both = F.size(F.array_intersect("gx", "gy")).cast("long")
    return (pairs.join(gx, "x").join(gy, "y").withColumn("both", both)
            .select("x", "y", "both", (F.size("gx") + F.size("gy") - F.col("both")).alias("union")))


#: Rounds in which a bucket names one pivot, before the exact prefix rule.
PIVOT_ROUNDS = 3
#: Rows per Arrow batch: rows are whole texts or gram sets.
ARROW_ROWS = 256


def near_copies(files: DataFrame, threshold: float = 0.8, bands: int = 16, rows: int = 4,
                shingle: int = 5) -> DataFrame:
    """R4 near: (path, representative, similarity) for each document that some
    chain of links joins to another.  Documents link when the Jaccard similarity
    of their whole gram sets reaches ``threshold``; the representative is the
    smallest path of the component and ``similarity`` the exact Jaccard with it
    (below the threshold where others link the two).

    Candidates share an LSH bucket.  In each pivot round every bucket that spans
    several components compares its members with one pivot and confirmed links
    contract the components; what still spans several is compared by an exact
    prefix rule, so no bucket is expanded into its pairs and no link is capped.
    ``path`` is the key of ``files``."""
    t = Fraction(str(threshold))
    num, den = t.numerator, t.denominator
    spark = files.sparkSession
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    prof = cut_lineage(minhash_signatures(files, shingle, bands * rows))
    # equal gram sets are one class, named by its smallest path
    classes = cut_lineage(prof.groupBy("set_id").agg(
        F.min("path").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    slots = classes.select("rep", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)),
                                                           lambda b: F.xxhash64(b, F.slice("sig", b * rows + 1, rows))))
                           .alias("band", "bucket"))
    several = slots.groupBy("band", "bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi")
    slots = cut_lineage(slots.join(several.select("band", "bucket"), ["band", "bucket"]))
    labels = cut_lineage(slots.select("rep").distinct().withColumn("comp", F.col("rep")))
    narrow = classes.select("rep", "n", "sig")
    own = join_small(files.select("path", "content"), labels.select(F.col("rep").alias("path")), "path", "left_semi")
    grams = cut_lineage(_grams(own, shingle))
    # a pair is read in full when its signatures agree up to six standard errors below the threshold
    least = threshold - 6 * (threshold * (1 - threshold) / (bands * rows)) ** 0.5
    agree = F.size(F.filter(F.arrays_zip("sx", "sy"), lambda z: z["sx"] == z["sy"])) / float(bands * rows)
    tested = None
    for r in range(PIVOT_ROUNDS + 1):
        where = slots.join(labels, "rep")
        spans = (where.groupBy("band", "bucket").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"),
            F.min_by(F.struct("rep", "comp"), F.xxhash64("rep", F.lit(r))).alias("p")).filter("lo <> hi"))
        if r < PIVOT_ROUNDS:
            pairs = (where.join(spans.select("band", "bucket", "p"), ["band", "bucket"]).filter("comp <> p.comp")
                     .select(F.col("rep").alias("x"), F.col("p.rep").alias("y")))
        else:
            rest = cut_lineage(where.join(spans.select("band", "bucket"), ["band", "bucket"]).select("rep", "comp").distinct())
            pairs = _rarest_shared(rest, grams, num, den)
        pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["x", "y"], "left_anti")
        pairs = cut_lineage(pairs)
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.union(pairs)
        alike = (pairs.join(narrow.toDF("x", "nx", "sx"), "x").join(narrow.toDF("y", "ny", "sy"), "y")
                 .filter(den * F.least("nx", "ny") >= num * F.greatest("nx", "ny")).filter(agree >= least).select("x", "y"))
        links = cut_lineage(_shared(alike, grams).filter(f"{den} * both >= {num} * union").select("x", "y"))
        at = labels.toDF("x", "a")
        edges = links.join(at, "x").join(at.toDF("y", "b"), "y").select("a", "b").distinct()
        merged = _components(cut_lineage(edges)).withColumnRenamed("node", "comp")
        labels = cut_lineage(labels.join(merged, "comp", "left").select("rep", F.coalesce("component", "comp").alias("comp")))
    found = classes.select("set_id", "rep", "copies").join(labels, "rep", "left").select(
        "set_id", "rep", "copies", F.coalesce("comp", "rep").alias("comp"))
    linked = found.groupBy("comp").agg(F.sum("copies").alias("size")).filter("size > 1").select("comp")
    found = cut_lineage(found.join(linked, "comp"))
    far = _shared(found.filter("rep <> comp").select(F.col("rep").alias("x"), F.col("comp").alias("y")), grams)
    far = far.select(F.col("x").alias("rep"), F.round(F.col("both") / F.col("union"), 6).alias("s"))
    found = found.join(far, "rep", "left").select("set_id", F.col("comp").alias("representative"),
                                                  F.coalesce("s", F.lit(1.0)).alias("similarity"))
    return prof.select("path", "set_id").join(found, "set_id").select("path", "representative", "similarity")
