"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words.  Every passage of
every whole text is encoded as a vector of character-class and word
statistics (numpy over the bytes of a batch, no loop over words), a hidden
layer embeds it, gated attention (tanh times sigmoid) weighs the passages of
a document, and a logistic unit scores the weighted mean of the embeddings.
Weights are learned from document labels only, by Adam on the log loss, on at
most ``SAMPLE`` labelled documents (those with the least hash of doc_id, a
documented bound); labels, lang, source and doc_id are never inputs.  Scoring
is one narrow pass over the documents.

Defined results: null and empty texts are one passage of zeros and get a
score like any other; rows with a null label are not learned from; without
labels every score is 0.5; repeated rows are scored alike; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Words, map_batches, unused

PASSAGE_WORDS = 64
SAMPLE = 6000
HIDDEN, GATE = 16, 8
EPOCHS, RATE, DECAY = 250, 0.02, 1e-4
THRESHOLD = 0.3

#: Character classes counted per passage (fixed values: which bytes belong together).
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!", "?", ".,;:", "|", "#*$%&", "<>",
           "@", "\"'`", "()[]{}", "/\\_=+-~^")
_CLASS = np.full(256, len(CLASSES), dtype=np.int64)          # any other byte, such as those of non-ASCII letters
for _i, _chars in enumerate(CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _i
N_CLASSES = len(CLASSES) + 1
N_FEATURES = N_CLASSES + 6


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document of each passage, feature matrix); at least one passage a text."""
    n = len(texts)
    w = Words(texts, lower=True)
    count = np.bincount(w.doc, minlength=n)
    first_word = np.concatenate(([0], np.cumsum(count)))
    passages = np.maximum(1, -(-count // PASSAGE_WORDS))
    first = np.concatenate(([0], np.cumsum(passages)))
    total = int(first[-1])
    doc = np.repeat(np.arange(n), passages)
    word_at = first[w.doc] + (np.arange(len(w.doc)) - first_word[w.doc]) // PASSAGE_WORDS
    x = np.zeros((total, N_FEATURES))
    if len(w.doc) == 0:
        return doc, x
    size = w.end - w.start
    # bytes inside words, each with the passage of its word
    inside = np.repeat(w.start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    byte_at = np.repeat(word_at, size)
    x[:, :N_CLASSES] = np.bincount(byte_at * N_CLASSES + _CLASS[w.raw[inside]], minlength=total * N_CLASSES).reshape(total, N_CLASSES)
    n_bytes = np.maximum(1, x[:, :N_CLASSES].sum(axis=1, keepdims=True))
    x[:, :N_CLASSES] = np.sqrt(x[:, :N_CLASSES] / n_bytes)
    n_words = np.bincount(word_at, minlength=total)
    some = np.maximum(1, n_words)
    order = np.lexsort((w.hash, word_at))
    p, h = word_at[order], w.hash[order]
    new = np.concatenate(([True], (p[1:] != p[:-1]) | (h[1:] != h[:-1])))
    again = np.concatenate(([False], (w.hash[1:] == w.hash[:-1]) & (word_at[1:] == word_at[:-1])))
    mean = np.bincount(word_at, weights=size, minlength=total) / some
    square = np.bincount(word_at, weights=size.astype(float) ** 2, minlength=total) / some
    upper = np.bincount(word_at[np.isin(w.raw[w.start], np.frombuffer(CLASSES[1].encode(), np.uint8))], minlength=total)
    x[:, N_CLASSES:] = np.column_stack([
        mean / 8, np.sqrt(np.maximum(0, square - mean * mean)) / 8, np.bincount(p[new], minlength=total) / some,
        np.bincount(word_at[again], minlength=total) / some, np.log1p(n_words) / 4, upper / some])
    return doc, x


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        doc, x = encode(b.column("text"))
        at = np.searchsorted(doc, np.arange(b.num_rows + 1))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("y"), pa.array([x[i:j].astype("<f4").tobytes() for i, j in zip(at, at[1:])], pa.binary())],
            names=["doc_id", "y", "x"])


def learnable() -> Column:
    """Rows that labels may be learned from; the others are held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0


def training_bags(docs: DataFrame, labels: DataFrame) -> list:
    """Encoded passages and labels of at most SAMPLE documents, in doc_id order."""
    # 1 % more than SAMPLE is a bound too, so the label side is a checked broadcast of two numbers a row
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
              .where(learnable() & F.col("y").isNotNull())
              .orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(SAMPLE).dropDuplicates(["doc_id"]))
    bags = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = map_batches(bags.select("doc_id", "y", "text"), _encode_batches, "doc_id long, y double, x binary").collect()
    return sorted(rows, key=lambda r: (r.doc_id, bytes(r.x)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def forward(w: dict, x: np.ndarray, first: np.ndarray, doc: np.ndarray) -> dict:
    """Scores of bags and what the gradients need; ``first`` is each bag's first passage."""
    h = np.tanh((x - w["mean"]) / w["sd"] @ w["H"] + w["hb"])
    t, s = np.tanh(h @ w["V"] + w["vb"]), _sigmoid(h @ w["U"] + w["ub"])
    e = (t * s) @ w["a"]
    e = np.exp(e - np.maximum.reduceat(e, first)[doc])
    att = e / np.add.reduceat(e, first)[doc]
    z = np.add.reduceat(att[:, None] * h, first, axis=0)
    return {"h": h, "t": t, "s": s, "att": att, "z": z, "p": _sigmoid(z @ w["c"] + w["cb"])}


def gradients(w: dict, x: np.ndarray, first: np.ndarray, doc: np.ndarray, y: np.ndarray) -> dict:
    f = forward(w, x, first, doc)
    d = (f["p"] - y) / len(y)
    dz = d[:, None] * w["c"]
    dh = f["att"][:, None] * dz[doc]
    datt = (f["h"] * dz[doc]).sum(axis=1)
    de = f["att"] * (datt - np.add.reduceat(f["att"] * datt, first)[doc])
    gate = f["t"] * f["s"]
    dt = de[:, None] * w["a"] * f["s"] * (1 - f["t"] ** 2)
    ds = de[:, None] * w["a"] * f["t"] * f["s"] * (1 - f["s"])
    dh = (dh + dt @ w["V"].T + ds @ w["U"].T) * (1 - f["h"] ** 2)
    return {"c": f["z"].T @ d, "cb": d.sum(), "a": gate.T @ de, "V": f["h"].T @ dt, "vb": dt.sum(axis=0), "U": f["h"].T @ ds,
            "ub": ds.sum(axis=0), "H": ((x - w["mean"]) / w["sd"]).T @ dh, "hb": dh.sum(axis=0)}


def train(rows: list) -> dict:
    """Weights from the bags of ``training_bags``."""
    rng = np.random.default_rng(5)
    init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {"mean": np.zeros(N_FEATURES), "sd": np.ones(N_FEATURES), "H": init(N_FEATURES, HIDDEN), "hb": np.zeros(HIDDEN),
         "V": init(HIDDEN, GATE), "vb": np.zeros(GATE), "U": init(HIDDEN, GATE), "ub": np.zeros(GATE), "a": np.zeros(GATE),
         "c": np.zeros(HIDDEN), "cb": np.float64(0)}
    if not rows:
        return w
    bags = [np.frombuffer(r.x, dtype="<f4").reshape(-1, N_FEATURES) for r in rows]
    x, y = np.concatenate(bags).astype(float), np.array([r.y for r in rows])
    size = np.array([len(b) for b in bags])
    first, doc = np.concatenate(([0], np.cumsum(size)[:-1])), np.repeat(np.arange(len(bags)), size)
    w |= {"mean": x.mean(axis=0), "sd": x.std(axis=0) + 0.02, "a": init(GATE), "c": init(HIDDEN)}
    m, v = {}, {}
    for step in range(1, EPOCHS + 1):
        for k, g in gradients(w, x, first, doc, y).items():
            g = g + DECAY * w[k]
            m[k] = 0.9 * m.get(k, 0) + 0.1 * g
            v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
            w[k] = w[k] - RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return w


def score(docs: DataFrame, weights: dict, passthrough: list[str] | None = None, into: str = "quality_score_") -> DataFrame:
    """``passthrough`` columns (doc_id alone by default) and the score, of every row."""
    keep = passthrough or ["doc_id"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            doc, x = encode(b.column("text"))
            p = forward(weights, x, np.searchsorted(doc, np.arange(b.num_rows)), doc)["p"] if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(p, pa.float64())], names=[*keep, into])

    slim = docs.select(*dict.fromkeys([*keep, "text"]))
    kinds = dict(slim.dtypes)
    return map_batches(slim, batches, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", `{into}` double")


def filter_documents(docs: DataFrame, weights: dict) -> DataFrame:
    """The rows scored at least THRESHOLD, all columns unchanged; narrow."""
    into = unused("quality_score_", docs)
    return score(docs, weights, docs.columns, into).where(F.col(into) >= THRESHOLD).drop(into)
