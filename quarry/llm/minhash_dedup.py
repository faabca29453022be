"""MinHash near-dedup by min-max hashing, with exact confirmation.

One hash function a permutation gives two signature values, the least and the
greatest hash of the document's shingles, so 32 evaluations fill a signature
of 64; it is banded in fours.  Documents with equal shingle sets form a class
first (128-bit identity of the set), and only class representatives go on.

Candidates of a bucket are never expanded into all pairs of a group: in each
of ``PIVOT_ROUNDS`` rounds every bucket that still spans several components
names one pivot, every member outside the pivot's component is compared with
it, and confirmed links contract the components.  The members of buckets that
then still span components are compared by an exact prefix rule: with the
shingles of every set in ascending order of frequency, two sets of sizes m and
n that link share at least ``need = ceil(num * (m + n) / (num + den))`` of them,
so the first shared one comes before the last ``need`` of both.  Only pairs that
share a shingle there, and whose parity sketches differ in no more slots than
two sets that link can, are compared: no cap drops a link, and texts that
resemble each other below the threshold mostly fall out before they are paired.
Links are confirmed on the full shingle sets of whole texts.

Defined results: null or empty text or text without words has an empty set
and links with nothing; rows of one doc_id are one document; a null doc_id
gets a null component and stays; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, Words, connected_components, map_batches, mix64, text_key, unused

PERMUTATIONS = 32
BAND = 4
PIVOT_ROUNDS = 3
#: Ids (8 bytes each) that may be broadcast; beyond, the join shuffles.
BROADCAST_IDS = 1_000_000
#: Slots of the sketches that tell sets apart before their texts are read.
PARITY_BITS = 1024
#: Shingle rows that leave a Python worker at a time.
SET_ROWS = 1 << 16
_SEEDS = mix64(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

SIG_SCHEMA = "doc_id long, n_shingles long, set_a long, set_b long, signature binary, bands array<long>"


def signature(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows of [min, max] per permutation, of the shingle hashes ``h`` cut at ``first``."""
    out = np.empty((len(first), 2 * PERMUTATIONS), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i, s in enumerate(_SEEDS):
            v = mix64(h ^ s)
            out[:, 2 * i], out[:, 2 * i + 1] = np.minimum.reduceat(v, first), np.maximum.reduceat(v, first)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band of BAND values."""
    n_bands = sig.shape[1] // BAND
    keys = np.broadcast_to(np.arange(1, n_bands + 1, dtype=np.uint64), (len(sig), n_bands)).copy()
    with np.errstate(over="ignore"):
        for i in range(BAND):
            keys = mix64(keys * np.uint64(0x100000001B3) + sig[:, i::BAND])
    return keys


def _batches(k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n = b.num_rows
            doc, h = Words(b.column("text"), lower=True).shingles(k, n)
            order = np.argsort(doc, kind="stable")
            doc, h = doc[order], h[order]
            edge = np.searchsorted(doc, np.arange(n + 1))
            count, a, c = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            with np.errstate(over="ignore"):
                for i in np.flatnonzero(edge[1:] > edge[:-1]):
                    own = np.unique(h[edge[i]:edge[i + 1]])
                    count[i] = len(own)
                    a[i], c[i] = mix64(own).sum(dtype=np.uint64), mix64(own ^ _SEEDS[0]).sum(dtype=np.uint64)
            some = np.flatnonzero(count)
            sig = signature(h, edge[some]) if len(some) else np.zeros((0, 2 * PERMUTATIONS), np.uint64)
            low = (sig & np.uint64(0xFFFF)).astype("<u2")
            keys = band_keys(sig).view(np.int64)
            sigs, bands = [None] * n, [None] * n
            for j, i in enumerate(some):
                sigs[i], bands[i] = low[j].tobytes(), keys[j]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(count), pa.array(a.view(np.int64)), pa.array(c.view(np.int64)),
                 pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_a", "set_b", "signature", "bands"])
    return run


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """Set size, set identity, signature (16 bits of each value) and band keys; one pass over whole texts."""
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _batches(k), SIG_SCHEMA)


def _alike(least: float):
    """Keeps pairs whose signatures agree in at least ``least`` of the values:
    six standard errors below the threshold, so a lost link is a 1e-9 event."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(b.num_rows, -1) for c in ("sx", "sy"))
                yield b.filter(pa.array((x == y).mean(axis=1) >= least)).select(["x", "y"])
    return run


def _sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of a batch, in that order."""
    doc, h = Words(texts, lower=True).shingles(k, len(texts))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))[:len(h)]
    return doc[new], h[new]


def _set_rows(k: int):
    """One row per distinct shingle of every text."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            doc, h = _sets(b.column("text"), k)
            size = np.bincount(doc, minlength=b.num_rows)
            for lo in range(0, len(h), SET_ROWS):
                at = doc[lo:lo + SET_ROWS]
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).take(pa.array(at)) for c in ("rep", "comp", "key")], pa.array(size[at]),
                     pa.array(h[lo:lo + SET_ROWS].view(np.int64))], names=["rep", "comp", "key", "n", "h"])
    return run


def _sketches(k: int):
    """Per text the parity of its shingles in each of PARITY_BITS slots of a hash."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            doc, h = _sets(b.column("text"), k)
            with np.errstate(over="ignore"):
                slot = (mix64(h ^ _SEEDS[1]) % np.uint64(PARITY_BITS)).astype(np.int64)
            edge, parity = np.searchsorted(doc, np.arange(b.num_rows + 1)), []
            for i in range(b.num_rows):
                odd = np.bincount(slot[edge[i]:edge[i + 1]], minlength=PARITY_BITS).astype(np.uint8) & 1
                parity.append(np.packbits(odd).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("key"), pa.array(parity, pa.list_(pa.int64()))], names=["rep", "key", "parity"])
    return run


def _differences(x: str, y: str):
    """Slots in which two sketches differ: never more than the shingles that are in one set only."""
    parts = [F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(PARITY_BITS // 64)]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def _rarest_shared(rest: DataFrame, texts: DataFrame, k: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Pairs (x, y) of ``rest`` (rep, comp) across components that may link by the
    prefix rule; every pair that links is among them.

    Families of texts that resemble each other below the threshold share rare
    shingles too.  They fall out in the join already: a link allows at most
    ``n_x + n_y - 2 need`` shingles in one set only, and the parity sketches of
    two sets never differ in more slots than that."""
    own = (rest.join(texts.select(F.col("doc_id").alias("rep"), "text", text_key().alias("key")), "rep")
           .dropDuplicates(["rep", "key"]))
    rows = scratch.save(map_batches(own.select("rep", "comp", "key", "text"), _set_rows(k), "rep long, comp long, key long, n long, h long"), "sets")
    often = (rows.groupBy("h").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("df > 1"))
    one = Window.partitionBy("rep", "key")
    # shingles that no other set has come first in the order and need no row, only their number
    place = F.col("n") - F.count("*").over(one) + F.row_number().over(one.orderBy("df", "h"))
    first = (rows.join(often, "h").withColumn("place", place)
             .where(f"lo <> hi and place <= n - ({num} * n + {den - 1}) div {den} + 1"))
    sketches = scratch.save(map_batches(own.select("rep", "key", "text"), _sketches(k), "rep long, key long, parity array<long>"), "sketches")
    first = scratch.save(first.select("h", "rep", "key", "comp", "n", "place").join(sketches, ["rep", "key"]).drop("key"), "prefixes")
    x, y = (first.select("h", *[F.col(c).alias(c[0] + s) for c in ("comp", "n", "place")], F.col("parity").alias(f"b{s}"), F.col("rep").alias(s)) for s in "xy")
    need = f"({num} * (nx + ny) + {num + den - 1}) div {num + den}"
    return (x.join(y, "h").where("x < y and cx <> cy").where(f"px + {need} <= nx + 1 and py + {need} <= ny + 1")
            .where(f"{den} * least(nx, ny) >= {num} * greatest(nx, ny)").where(_differences("bx", "by") <= F.expr(f"nx + ny - 2 * ({need})")).select("x", "y"))


def _confirm(k: int, num: int, den: int):
    """Keeps pairs with den * |intersection| >= num * |union| of the full sets."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n = b.num_rows
            (dx, hx), (dy, hy) = (_sets(b.column(c), k) for c in ("tx", "ty"))
            d, h = np.concatenate((dx, dy)), np.concatenate((hx, hy))
            order = np.lexsort((h, d))
            d, h = d[order], h[order]
            both = np.bincount(d[1:][(d[1:] == d[:-1]) & (h[1:] == h[:-1])], minlength=n)
            union = np.bincount(d, minlength=n) - both
            yield b.filter(pa.array((den * both >= num * union) & (union > 0))).select(["x", "y"])
    return run


def components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest
    doc_id reachable over links with Jaccard >= num / den on ``k``-word
    shingles) and kept (doc_id = component_id)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    sigs = scratch.save(signatures(docs, k), "signatures")
    classes = (sigs.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b", "n_shingles")
               .agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("bands").alias("bands")))
    classes = scratch.save(classes, "classes")
    slots = classes.select("rep", F.explode("bands").alias("key"))
    shared = slots.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("key")
    slots = scratch.save(slots.join(shared, "key"), "slots")
    labels = scratch.save(slots.select("rep").distinct().withColumn("comp", F.col("rep")), "labels0")
    texts = _texts(docs, labels, scratch)
    narrow = classes.select("rep", "n_shingles", "signature")
    tested = None
    for r in range(PIVOT_ROUNDS + 1):
        where = slots.join(labels, "rep")
        spans = (where.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                          F.min_by(F.struct("rep", "comp"), F.xxhash64("rep", F.lit(r))).alias("p")).where("lo <> hi"))
        if r < PIVOT_ROUNDS:
            pairs = where.join(spans, "key").where("comp <> p.comp").select(F.col("rep").alias("x"), F.col("p.rep").alias("y"))
        else:
            rest = scratch.save(where.join(spans.select("key"), "key").select("rep", "comp").distinct(), "rest")
            pairs = _rarest_shared(rest, texts, k, num, den, scratch)
        pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["x", "y"], "left_anti")
        pairs = scratch.save(pairs, f"pairs{r}")
        if pairs.isEmpty():
            continue   # a round may name only pivots that were tested before; the prefix rule still follows
        tested = pairs if tested is None else tested.union(pairs)
        links = scratch.save(_linked(pairs, narrow, texts, k, num, den), f"links{r}")
        at = labels.select(F.col("rep").alias("x"), F.col("comp").alias("a"))
        edges = links.join(at, "x").join(at.select(F.col("x").alias("y"), F.col("a").alias("b")), "y").select("a", "b").distinct()
        merged = connected_components(scratch.save(edges, f"edges{r}"), scratch, f"cc{r}")
        labels = labels.join(merged.withColumnRenamed("node", "comp"), "comp", "left").select("rep", F.coalesce("component", "comp").alias("comp"))
        labels = scratch.save(labels, f"labels{r + 1}")
    found = classes.select("set_a", "set_b", F.col("n_shingles").alias("n_"), "rep").join(labels, "rep", "left")
    found = found.select("set_a", "set_b", "n_", F.coalesce("comp", "rep").alias("comp"))
    out = sigs.select("doc_id", "n_shingles", "set_a", "set_b").join(
        found.withColumnRenamed("n_", "n_shingles"), ["set_a", "set_b", "n_shingles"], "left")
    # rows of one doc_id are one document: it lies in the least component any of its texts is in
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return (out.withColumn("component_id", component)
            .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))


def _ids(ids: DataFrame, column: str) -> DataFrame:
    """Long ids, broadcast when their count is under the bound."""
    return F.broadcast(ids) if ids.select(column).count() <= BROADCAST_IDS else ids


def _texts(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Whole texts of the documents that share a bucket."""
    some = labels.select(F.col("rep").alias("doc_id"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return scratch.save(slim.join(_ids(some, "doc_id"), "doc_id", "left_semi"), "texts")


def _linked(pairs: DataFrame, narrow: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    j = num / den
    side = lambda s: narrow.select(F.col("rep").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("signature").alias(f"s{s}"))
    sized = pairs.join(side("x"), "x").join(side("y"), "y").where(den * F.least("nx", "ny") >= num * F.greatest("nx", "ny"))
    least = j - 6 * (j * (1 - j) / (2 * PERMUTATIONS)) ** 0.5
    alike = map_batches(sized.select("x", "y", "sx", "sy"), _alike(least), "x long, y long")
    full = (alike.join(texts.select(F.col("doc_id").alias("x"), F.col("text").alias("tx")), "x")
            .join(texts.select(F.col("doc_id").alias("y"), F.col("text").alias("ty")), "y"))
    return map_batches(full.select("x", "y", "tx", "ty"), _confirm(k, num, den), "x long, y long").distinct()


def filter_documents(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each group, all columns unchanged; of rows with one
    doc_id one stays."""
    scratch = Scratch(docs.sparkSession, "minhash-filter")
    judged = scratch.save(components(docs, k, num, den).where("doc_id is not null")
                          .groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(~F.col("kept")).alias("out")), "judged")
    gone_id, again_id = unused("gone_id_", docs), unused("again_id_", docs)
    gone = judged.where("out").select(F.col("doc_id").alias(gone_id))
    again = judged.where("n > 1 and not out").select(F.col("doc_id").alias(again_id))
    kept = docs.join(_ids(gone, gone_id), docs["doc_id"] == F.col(gone_id), "left_anti")
    if again.isEmpty():
        return kept
    match = kept["doc_id"] == F.col(again_id)
    return kept.join(_ids(again, again_id), match, "left_anti").unionByName(
        kept.join(_ids(again, again_id), match, "left_semi").dropDuplicates(["doc_id"]))
