"""Language identification by prediction by partial matching (PPM).

Per language a byte context tree of up to ORDER bytes holds how often each
byte followed each context.  A byte's code length is that of PPM method C with
exclusion: in the longest known context a seen byte of count n has probability
n / (T + D), T bytes and D distinct ones seen; an unseen one costs the escape
D / (T + D) and is coded in the context one byte shorter, whose counts leave
out the bytes already refused; below order 0 all bytes left are alike.  The
statistics stay frozen while scoring, so a text's code length is the exact sum
over its bytes, all of them, plus that of the language's share of the learned
documents.  The language of the least code length wins (ties: the smallest
name); its posterior probability is the score.

Code lengths are whole numbers of 1/4096 bit, so sums don't depend on how a
text is cut into batches.  A text counts as preceded by ORDER line feeds.

Learning: at most SAMPLE distinct texts a language, chosen by a hash, whole
texts; their byte sequences are counted by Spark; contexts are kept from
the least count on at which all languages together fit MOST_SEQUENCES and each
its share of it (a rarer sequence is never kept without its suffixes, so the
tree stays closed).  At most LANGUAGES languages are learned, the most
frequent ones.  These bounds limit what is broadcast; scoring is one narrow
pass over all documents.

Defined results: a text that is null or has no letter (Unicode category L) is
``und`` with score 0; so is every text if no language was learned; repeated
rows are scored each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import map_batches, text_buffers

ORDER = 3
#: Learned documents a language, languages, and byte sequences of all orders and languages.
SAMPLE, LANGUAGES, MOST_SEQUENCES = 1000, 200, 1_000_000
#: Bytes scored together: bounds the working arrays.
SLICE = 1 << 18
UNIT = 4096
UNKNOWN = "und"


# ---------------------------------------------------------------- byte sequences

def sequences(data: np.ndarray) -> np.ndarray:
    """For each byte the ORDER bytes before it and itself, as one number."""
    padded = np.concatenate((np.full(ORDER, 0x0A, np.uint8), data)).astype(np.uint32)
    n = len(data)
    out = padded[:n].copy()
    for k in range(1, ORDER + 1):
        out <<= np.uint32(8)
        out |= padded[k:k + n]
    return out


def _count_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, sequence of ORDER + 1 bytes, times) of each slice of the texts."""
    for b in it:
        langs = b.column("lang").to_pylist()
        off, data = text_buffers(b.column("text"))
        for i, lang in enumerate(langs):
            own = sequences(data[off[i]:off[i + 1]])
            for at in range(0, len(own), SLICE):
                seq, times = np.unique(own[at:at + SLICE], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seq), pa.string()), pa.array(seq.astype(np.int64)), pa.array(times)],
                                                 names=["lang", "seq", "n"])


# ---------------------------------------------------------------- one language's tree

def _lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted key, -1 where it is none."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Tree:
    """Counts of one language; ``counts[k]`` are the (sequence of k + 1 bytes,
    times) kept, k bytes of context and the byte that follows."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        self.seq, self.n, self.context, self.total, self.distinct, self.below = [], [], [], [], [], []
        for k, (seq, n) in enumerate(counts):
            order = np.argsort(seq)
            seq, n = seq[order].astype(np.uint64), n[order].astype(np.float64)
            context, at = np.unique(seq >> np.uint64(8), return_inverse=True)
            self.seq.append(seq)
            self.n.append(n)
            self.context.append(context)
            self.total.append(np.bincount(at, n, len(context)))
            self.distinct.append(np.bincount(at, minlength=len(context)).astype(np.float64))
            # times the bytes seen here were seen in the context one shorter: what exclusion takes from it
            below = np.zeros(len(context))
            if k:
                suffix = _lookup(self.seq[k - 1], seq & np.uint64((1 << 8 * k) - 1))
                below = np.bincount(at, self.n[k - 1][suffix], len(context)) if len(seq) else below
            self.below.append(below)

    def bits(self, wanted: np.ndarray) -> np.ndarray:
        """Code length in bits of the last byte of each sequence of ORDER + 1."""
        wanted = wanted.astype(np.uint64)
        out = np.zeros(len(wanted))
        left = np.arange(len(wanted))
        taken, refused = np.zeros(len(wanted)), np.zeros(len(wanted))     # of the excluded bytes: times in this order, number
        for k in range(ORDER, -1, -1):
            w = wanted[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            c = _lookup(self.context[k], w >> np.uint64(8))
            known = c >= 0
            # without the context nothing is excluded yet: trees are closed under suffixes
            room = np.where(known, self.total[k][c] - taken[left] + self.distinct[k][c] - refused[left], 0) if len(self.context[k]) else np.zeros(len(w))
            s = _lookup(self.seq[k], w)
            hit = s >= 0
            if hit.any():
                out[left[hit]] += np.log2(room[hit] / self.n[k][s[hit]])
            miss = ~hit & known
            if miss.any():
                new = self.distinct[k][c[miss]] - refused[left[miss]]
                out[left[miss]] += np.where(new > 0, np.log2(np.maximum(room[miss], 1) / np.maximum(new, 1)), 0)
                taken[left[miss]], refused[left[miss]] = self.below[k][c[miss]], self.distinct[k][c[miss]]
            left = left[~hit]
        out[left] += np.log2(256 - refused[left])
        return out


class Model:
    """Trees of all languages; the code lengths of the sequences that any of
    them keeps stand in one table, others are worked out as they come."""

    def __init__(self, langs: list[str], share: list[float], trees: list[Tree]):
        self.langs, self.trees = langs, trees
        self.prior = np.array([self.units(-np.log2(x)) for x in share], dtype=np.int64)
        self.known = np.unique(np.concatenate([t.seq[ORDER] for t in trees])).astype(np.uint32)
        self.table = self._costs(self.known)

    @staticmethod
    def units(bits: np.ndarray) -> np.ndarray:
        return np.rint(np.asarray(bits) * UNIT).astype(np.int64)

    def _costs(self, seq: np.ndarray) -> np.ndarray:
        return np.stack([self.units(t.bits(seq)) for t in self.trees], axis=1).reshape(len(seq), len(self.langs)).astype(np.int32)

    def lengths(self, off: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Code lengths (texts, languages) of texts without the languages' shares."""
        out = np.zeros((len(off) - 1, len(self.langs)), dtype=np.int64)
        # the texts one after another, each after ORDER line feeds, which themselves aren't coded
        size = np.diff(off)
        for lo, hi in _groups(size):
            raw = data[off[lo]:off[hi]]
            if hi - lo == 1:
                for at in range(0, len(raw), SLICE):
                    before = raw[max(at - ORDER, 0):at]
                    own = sequences(raw[at - len(before):at + SLICE])[len(before):] if at >= ORDER else sequences(raw[:SLICE])
                    out[lo] += self._sum(own, np.zeros(1, np.int64))[0]
                continue
            starts = off[lo:hi] - off[lo]
            own = sequences(raw)
            full = np.flatnonzero(size[lo:hi])
            for k in range(ORDER):                     # the first bytes of a text have seen line feeds
                has = full[size[lo:hi][full] > k]
                at = starts[has] + k
                fresh = np.zeros(len(at), np.uint32)
                for i in range(ORDER + 1):
                    back = ORDER - i
                    fresh = fresh << np.uint32(8) | (raw[at - back].astype(np.uint32) if back <= k else np.uint32(0x0A))
                own[at] = fresh
            if len(full):
                out[lo + full] += self._sum(own, starts[full])
        return out

    def _sum(self, own: np.ndarray, starts: np.ndarray) -> np.ndarray:
        at = _lookup(self.known, own)
        cost = self.table[at].astype(np.int64) if len(self.known) else np.zeros((len(own), len(self.langs)), np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            seq, back = np.unique(own[new], return_inverse=True)
            cost[new] = self._costs(seq)[back]
        return np.add.reduceat(cost, starts, axis=0)

    def judge(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, posterior probability) of each text."""
        whole = lengths + self.prior
        best = np.argmin(whole, axis=1)
        gap = (whole - whole[np.arange(len(whole)), best][:, None]) / UNIT
        return best, 1 / np.exp2(-np.minimum(gap, 2000)).sum(axis=1)


def _groups(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most SLICE bytes together, or one longer text."""
    lo, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > lo and total + n > SLICE:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(size):
        yield lo, len(size)


# ---------------------------------------------------------------- learning and scoring tables

def learn(docs: DataFrame, learnable: Column) -> Model | None:
    """Model from ``text`` and ``lang`` of the learnable rows; None if there
    are none with a text and a language."""
    rows = docs.where(learnable).select(F.col("lang").cast("string").alias("lang"), "text").where("lang is not null and length(text) > 0")
    shares = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not shares:
        return None
    # about twice SAMPLE by a hash, copies once, then the first SAMPLE of them
    odds = F.lit(None).cast("double")
    for r in shares:
        odds = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, (2 * SAMPLE + 20) / r["count"]))).otherwise(odds)
    near = rows.withColumn("draw", F.xxhash64("text", F.lit(11))).where((F.col("draw").cast("double") + 2.0 ** 63) / 2.0 ** 64 < odds)
    near = near.groupBy("lang", "draw").agg(F.min("text").alias("text"))
    chosen = near.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("draw"))).where(F.col("place") <= SAMPLE)
    whole = map_batches(chosen.select("lang", "text"), _count_batches, "lang string, seq long, n long").groupBy("lang", "seq").agg(F.sum("n").alias("n"))
    # every order at once: the last k + 1 bytes of a sequence
    orders = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("seq").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("seq")) for k in range(ORDER + 1)]))
    counts = whole.select("lang", "n", orders.alias("o")).groupBy("lang", "o.k", "o.seq").agg(F.sum("n").alias("n")).persist()
    try:
        share = MOST_SEQUENCES // len(shares)
        # the least count from which a language's sequences fit its share
        steps: dict[str, list[tuple[int, int]]] = {}
        for r in counts.groupBy("lang", F.least("n", F.lit(10_000)).alias("n")).count().collect():
            steps.setdefault(r["lang"], []).append((r["n"], r["count"]))
        least = {}
        for lang, own in steps.items():
            kept, least[lang] = 0, 10_000
            for n, more in sorted(own, reverse=True):
                kept += more
                if kept > share:
                    break
                least[lang] = n
        floor = F.lit(None).cast("long")
        for lang, n in least.items():
            floor = F.when(F.col("lang") == lang, n).otherwise(floor)
        kept = counts.where(F.col("n") >= floor).toPandas()
    finally:
        counts.unpersist()
    by_lang = dict(list(kept.groupby("lang")))
    langs = sorted((r["lang"] for r in shares if r["lang"] in by_lang), key=str.encode)
    total = sum(r["count"] for r in shares)
    of = {r["lang"]: r["count"] / total for r in shares}
    trees = []
    for lang in langs:
        own = by_lang[lang]
        trees.append(Tree([(part["seq"].to_numpy(), part["n"].to_numpy()) for part in (own[own["k"] == k] for k in range(ORDER + 1))]))
    return Model(langs, [of[lang] for lang in langs], trees)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of every row: one narrow pass."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in it:
            n = b.num_rows
            pred, score = [UNKNOWN] * n, np.zeros(n)
            if own is not None:
                best, p = own.judge(own.lengths(*text_buffers(b.column("text"))))
                spoken = np.array(b.column("spoken").to_pylist(), dtype=bool)
                pred = [own.langs[i] if s else UNKNOWN for i, s in zip(best, spoken)]
                score = np.where(spoken, p, 0.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("spoken"))
    return map_batches(rows, batches, "doc_id long, lang_pred string, score double")
