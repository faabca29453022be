"""Merkle manifest of a table, with midstates for cheap re-folding.

A leaf is the SHA-256 of a row's fields.  Per group (language) the leaves, in
order, are hashed in runs of eight until one node remains, the subroot; the
subroots in order of their groups are hashed likewise to the root.  A child
enters its parent as 64 hexadecimal digits, exactly one block of SHA-256, so
the hash state before each child slot is eight 32-bit words.  Every parent
retains a copy of that state for each of its slots.  Folding a replaced child
resumes the state of its slot, takes the replacement and the siblings on its
right, and never reads those on its left.

Spread: leaves are put in order by one range shuffle (``positions``), so a
group of any size is split.  Three levels are built at a time: a page is a
tree over at most 512 consecutive nodes, one small task's work, and pages are
stored with their states.  Their tops are the next pass's nodes (1/512 of the
rows).  Folding goes the other way: each page gets the steps above it (state
of the slot, siblings), at most a few KB for its 512 leaves, and folds its
rows over its own three levels and then over those steps.  Only the root
itself comes to the driver.

Defined results: rows of equal doc_id (and null doc_id, which sort first) are
leaves of their own, ordered by their hashes; a row without doc_id is never
tampered with; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, map_batches, positions

FAN, DEPTH = 8, 3
PAGE = FAN ** DEPTH
#: Pages hashed together: bounds the working arrays.
TOGETHER = 16
WIDTH = 32


# ---------------------------------------------------------------- SHA-256 over arrays, with its state open

def _cube_root(n: int) -> int:
    r = 1 << -(-n.bit_length() // 3)
    while (s := (2 * r + n // (r * r)) // 3) < r:
        r = s
    return r


_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, isqrt(p) + 1))]
#: First 32 bits of the fractions of the primes' cube roots and square roots.
_ROUND = [np.uint32(_cube_root(p << 96) & 0xFFFFFFFF) for p in _PRIMES]
_START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _PRIMES[:8]], dtype=np.uint32)
_HEX = np.array([list(b"%02x" % i) for i in range(256)], dtype=np.uint8)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return x >> np.uint32(n) | x << np.uint32(32 - n)


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """One SHA-256 block for each column: state (8, n), block (16, n)."""
    w = list(block)
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        if t >= 16:
            x, y = w[t - 15], w[t - 2]
            w.append(w[t - 16] + w[t - 7] + (_turn(x, 7) ^ _turn(x, 18) ^ x >> np.uint32(3)) + (_turn(y, 17) ^ _turn(y, 19) ^ y >> np.uint32(10)))
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ e & (f ^ g)) + _ROUND[t] + w[t]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + (a & b | c & (a | b))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack((a, b, c, d, e, f, g, h))


def block_of(digests: np.ndarray) -> np.ndarray:
    """Digests (n, 32 bytes) as hexadecimal digits: one block (16, n) each."""
    return np.ascontiguousarray(_HEX[digests].reshape(-1, 64).view(">u4").astype(np.uint32).T)


def closed(state: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Digests (n, 32 bytes) of states that have taken ``count`` blocks."""
    last = np.zeros((16, state.shape[1]), dtype=np.uint32)
    last[0], last[15] = 1 << 31, count * 512
    return np.ascontiguousarray(compress(state, last).T.astype(">u4")).view(np.uint8).reshape(-1, WIDTH)


def parents(nodes: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digests, states (n, 8 slots, 8 words)) of the runs ``nodes[first:first + count]``."""
    state = np.repeat(_START[:, None], len(first), axis=1)
    kept = np.zeros((len(first), FAN, 8), dtype=np.uint32)
    for slot in range(FAN):
        live = np.flatnonzero(count > slot)
        kept[live, slot] = state[:, live].T
        state[:, live] = compress(state[:, live], block_of(nodes[first[live] + slot]))
    return closed(state, count), kept


def refold(kept: np.ndarray, new: np.ndarray, count: np.ndarray, n_right: np.ndarray, right) -> np.ndarray:
    """Digests of parents with one child replaced: ``kept`` (n, 8 words) is the
    state before its slot; ``right(rows, t)`` gives the t-th sibling on the right."""
    state = compress(np.ascontiguousarray(kept.T), block_of(new))
    for t in range(FAN - 1):
        live = np.flatnonzero(n_right > t)
        if not len(live):
            break
        state[:, live] = compress(state[:, live], block_of(right(live, t)))
    return closed(state, count)


# ---------------------------------------------------------------- pages

def levels_of(total: int) -> int:
    """Levels of a page in a pass over ``total`` nodes."""
    n, k = total, 0
    while n > 1 and k < DEPTH:
        n, k = -(-n // FAN), k + 1
    return k


def _before(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)[:-1])) if len(sizes) else sizes


class Pages:
    """Trees of several pages of the same number of levels.  ``levels[k]``
    holds the nodes of level k of all pages one after another, the bounds of
    their runs and the states that the runs' parents retain."""

    def __init__(self, sizes: np.ndarray, leaves: np.ndarray, levels: int, kept: list[np.ndarray] | None = None, inner: list[np.ndarray] | None = None):
        self.sizes, self.levels = sizes, []
        nodes, size = leaves, sizes
        for k in range(levels):
            runs = -(-size // FAN)
            page = np.repeat(np.arange(len(size)), runs)
            first = _before(size)[page] + FAN * (np.arange(len(page)) - _before(runs)[page])
            count = np.minimum(FAN, (_before(size) + size)[page] - first)
            tops, states = (inner[k], kept[k]) if kept is not None else parents(nodes, first, count)
            self.levels.append((nodes, first, count, states, np.repeat(np.arange(len(first)), count)))
            nodes, size = tops, runs
        self.tops = nodes

    @staticmethod
    def cut(size: int, levels: int) -> list[int]:
        """Parents per level of one page."""
        out = []
        for _ in range(levels):
            size = -(-size // FAN)
            out.append(size)
        return out

    @classmethod
    def stored(cls, rows: list[dict], levels: int) -> Pages:
        """From rows of the page table."""
        sizes = np.array([len(r["leaves"]) // WIDTH for r in rows], dtype=np.int64)
        leaves = np.frombuffer(b"".join(r["leaves"] for r in rows), np.uint8).reshape(-1, WIDTH)
        inner, kept = [[] for _ in range(levels)], [[] for _ in range(levels)]
        for r, size in zip(rows, sizes):
            nodes = np.frombuffer(r["inner"], np.uint8).reshape(-1, WIDTH)
            states = np.frombuffer(r["states"], "<u4").reshape(-1, FAN, 8)
            at = 0
            for k, n in enumerate(cls.cut(int(size), levels)):
                inner[k].append(nodes[at:at + n])
                kept[k].append(states[at:at + n])
                at += n
        return cls(sizes, leaves, levels, [np.concatenate(x) for x in kept], [np.concatenate(x) for x in inner])

    def rows(self) -> Iterator[tuple[bytes, bytes, bytes]]:
        """(inner nodes, states, top) of each page."""
        cuts = [self.cut(int(s), len(self.levels)) for s in self.sizes]
        at = [_before(np.array([c[k] for c in cuts], dtype=np.int64)) for k in range(len(self.levels))]
        tops = [lv[0] for lv in self.levels[1:]] + [self.tops]
        for p, c in enumerate(cuts):
            part = [slice(at[k][p], at[k][p] + n) for k, n in enumerate(c)]
            yield (b"".join(tops[k][s].tobytes() for k, s in enumerate(part)),
                   b"".join(self.levels[k][3][s].astype("<u4").tobytes() for k, s in enumerate(part)), self.tops[p].tobytes())

    def fold(self, new: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Tops after ``new`` replaces the leaf ``node``, each by itself."""
        for nodes, first, count, states, run in self.levels:
            up = run[node]
            slot = node - first[up]
            new = refold(states[up, slot], new, count[up], count[up] - slot - 1, lambda live, t, n=nodes, at=node: n[at[live] + 1 + t])
            node = up
        return new

    def steps(self, node: int) -> bytes:
        """The steps from a leaf to its page's top: per level slot, run length, state, siblings."""
        out = []
        for nodes, first, count, states, run in self.levels:
            up = run[node]
            lo, n = int(first[up]), int(count[up])
            out += [bytes((node - lo, n)), states[up, node - lo].astype("<u4").tobytes(), nodes[lo:node].tobytes(), nodes[node + 1:lo + n].tobytes()]
            node = int(up)
        return b"".join(out)


def read_steps(path: bytes) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(slot, run length, state, siblings) of each step, bottom up."""
    out, at = [], 0
    while at < len(path):
        slot, n = path[at], path[at + 1]
        state = np.frombuffer(path, "<u4", 8, at + 2)
        siblings = np.frombuffer(path, np.uint8, (n - 1) * WIDTH, at + 2 + WIDTH).reshape(-1, WIDTH)
        out.append((slot, n, state, siblings))
        at += 2 + n * WIDTH
    return out


def fold_steps(new: np.ndarray, paths: list[list], path: np.ndarray) -> np.ndarray:
    """Fold each digest over the steps of its path, all paths side by side."""
    new, k = new.copy(), 0
    while True:
        live = np.flatnonzero(np.array([len(p) > k for p in paths], dtype=bool)[path])
        if not len(live):
            return new
        of = path[live]
        used, at = np.unique(of, return_inverse=True)
        step = [paths[i][k] for i in used]
        slot, count = np.array([s[0] for s in step])[at], np.array([s[1] for s in step])[at]
        kept = np.stack([s[2] for s in step]).astype(np.uint32)[at]
        beside = np.zeros((len(step), FAN - 1, WIDTH), dtype=np.uint8)
        for i, s in enumerate(step):
            beside[i, :len(s[3])] = s[3]
        new[live] = refold(kept, new[live], count, count - slot - 1, lambda rows, t, a=at, s=slot, b=beside: b[a[rows], s[rows] + t])
        k += 1


# ---------------------------------------------------------------- the tree as tables

_PAGE_SCHEMA = ("group string, page long, total long, doc_ids array<long>, leaves binary, changed array<binary>, "
                "inner binary, states binary, top binary")


def _by_levels(rows: list[dict]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of a batch, ``TOGETHER`` pages of the same number of levels at a time."""
    kinds: dict[int, list[dict]] = {}
    for r in rows:
        kinds.setdefault(levels_of(r["total"]), []).append(r)
    for levels, own in kinds.items():
        for i in range(0, len(own), TOGETHER):
            yield levels, own[i:i + TOGETHER]


def _page_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for i in range(0, batch.num_rows, TOGETHER):
            rows = batch.slice(i, TOGETHER).to_pylist()
            for r in rows:
                r["leaves"] = b"".join(x["digest"] for x in r["items"])
            for levels, own in _by_levels(rows):
                sizes = np.array([len(r["items"]) for r in own], dtype=np.int64)
                made = Pages(sizes, np.frombuffer(b"".join(r["leaves"] for r in own), np.uint8).reshape(-1, WIDTH), levels)
                inner, states, tops = zip(*made.rows())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["group"] for r in own], pa.string()), pa.array([r["page"] for r in own], pa.int64()),
                     pa.array([r["total"] for r in own], pa.int64()),
                     pa.array([[x["doc_id"] for x in r["items"]] for r in own], pa.list_(pa.int64())), pa.array([r["leaves"] for r in own], pa.binary()),
                     pa.array([[x["changed"] for x in r["items"]] for r in own], pa.list_(pa.binary())),
                     pa.array(inner, pa.binary()), pa.array(states, pa.binary()), pa.array(tops, pa.binary())],
                    names=["group", "page", "total", "doc_ids", "leaves", "changed", "inner", "states", "top"])


def _pages(nodes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Page table of nodes (group, pos, total, digest, doc_id, changed)."""
    paged = nodes.groupBy("group", F.floor(F.col("pos") / PAGE).alias("page")).agg(
        F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("pos", "doc_id", "digest", "changed"))).alias("items"))
    return scratch.save(map_batches(paged, _page_batches, _PAGE_SCHEMA), name)


def _passes(nodes: DataFrame, scratch: Scratch, name: str) -> list[DataFrame]:
    """Page tables from the nodes up to one page per group."""
    out = [_pages(nodes, scratch, f"{name}0")]
    while True:
        more = out[-1].where(F.col("total") > PAGE).select(
            "group", F.col("page").alias("pos"), F.ceil(F.col("total") / PAGE).cast("long").alias("total"), F.col("top").alias("digest"),
            F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("changed"))
        if more.isEmpty():
            return out
        out.append(_pages(more, scratch, f"{name}{len(out)}"))


class Manifest:
    """Page tables of the leaves' trees and of the tree over the subroots."""

    def __init__(self, lower: list[DataFrame], upper: list[DataFrame], ranks: DataFrame):
        self.lower, self.upper, self.ranks = lower, upper, ranks

    def root(self) -> str | None:
        top = self.upper[-1].where(F.col("total") <= PAGE).select(F.hex("top")).first()
        return top[0].lower() if top else None


def _field(c: Column) -> Column:
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaf(text: str | Column = "text") -> Column:
    """The leaf of a row as a binary digest."""
    fields = [F.col(c).cast("string") for c in ("doc_id", "source", "lang", "n_chars")] + [F.col(text) if isinstance(text, str) else text]
    return F.unhex(F.sha2(F.concat(*map(_field, fields)).cast("binary"), 256))


def ordered_leaves(docs: DataFrame, changed: Column, scratch: Scratch) -> DataFrame:
    """(group, pos, total, digest, doc_id, changed) of every row; ``changed``
    is the digest to fold instead of the leaf, or null."""
    rows = docs.select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("group"), F.col("doc_id").cast("long").alias("doc_id"),
                       leaf().alias("digest"), changed.alias("changed"))
    return positions(scratch.save(rows, "leaves"), "group", [F.asc_nulls_first("doc_id"), F.asc("digest")], scratch, "ordered")


def build(leaves: DataFrame, scratch: Scratch) -> Manifest:
    """The manifest over ordered leaves."""
    lower = _passes(leaves, scratch, "lower")
    tops = [t.where(F.col("total") <= PAGE).select("group", F.col("top").alias("digest")) for t in lower]
    subroots = tops[0]
    for t in tops[1:]:
        subroots = subroots.union(t)
    ranks = positions(scratch.save(subroots.withColumn("all", F.lit("")), "subroots"), "all", [F.asc("group")], scratch, "ranks")
    nodes = ranks.select(F.col("all").alias("group"), "pos", "total", "digest", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("changed"))
    return Manifest(lower, _passes(nodes, scratch, "upper"), ranks)


def _children(pages: DataFrame) -> DataFrame:
    """(group, child, digest, path) of every node of pages that have a ``path``
    above: the steps of its own page, then that path."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in batch.to_pylist():
                own = Pages.stored([r], levels_of(r["total"]))
                n = len(r["leaves"]) // WIDTH
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["group"]] * n, pa.string()), pa.array(range(r["page"] * PAGE, r["page"] * PAGE + n), pa.int64()),
                     pa.array([r["leaves"][i * WIDTH:(i + 1) * WIDTH] for i in range(n)], pa.binary()),
                     pa.array([own.steps(i) + r["path"] for i in range(n)], pa.binary()), pa.array([r["subroot"]] * n, pa.binary())],
                    names=["group", "child", "digest", "path", "subroot"])
    cols = ["group", "page", "total", "leaves", "inner", "states", "path", "subroot"]
    return map_batches(pages.select(*cols), batches, "group string, child long, digest binary, path binary, subroot binary")


def _with_paths(manifest: Manifest, scratch: Scratch) -> DataFrame:
    """The pages of leaves with the steps above them and their subroot."""
    nothing = F.lit(b"")
    at = None
    for k, pages in reversed(list(enumerate(manifest.upper))):
        last = pages.where(F.col("total") <= PAGE).withColumns({"path": nothing, "subroot": nothing})
        inner = pages.join(at.select("group", F.col("child").alias("page"), "path", "subroot"), ["group", "page"]) if at is not None else None
        at = scratch.save(_children(last if inner is None else inner), f"upper-steps{k}")
    tops = at.join(manifest.ranks.select("pos", F.col("group").alias("of")), F.col("child") == F.col("pos")).select(
        F.col("of").alias("group"), F.lit(0).cast("long").alias("page"), "path", F.col("digest").alias("subroot"))
    above = tops = scratch.save(tops, "group-steps")
    for k, pages in reversed(list(enumerate(manifest.lower))):
        here = pages.join(above, ["group", "page"])
        if k == 0:
            return here
        steps = scratch.save(_children(here), f"lower-steps{k}").select("group", F.col("child").alias("page"), "path", "subroot")
        # groups that end in the pass below have one page there
        ends = tops.join(manifest.lower[k - 1].where(F.col("total") <= PAGE).select("group", "page"), ["group", "page"])
        above = steps.union(ends.select("group", "page", "path", "subroot"))


def fold(manifest: Manifest, scratch: Scratch) -> DataFrame:
    """Every leaf folded to the root, with its replacement where it has one:
    doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    root = manifest.root()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(0, batch.num_rows, TOGETHER):
                for levels, rows in _by_levels(batch.slice(i, TOGETHER).to_pylist()):
                    yield _folded(rows, levels, root)
    cols = ["group", "page", "total", "doc_ids", "leaves", "changed", "inner", "states", "path", "subroot"]
    return map_batches(_with_paths(manifest, scratch).select(*cols), batches,
                       "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _folded(rows: list[dict], levels: int, root: str) -> pa.RecordBatch:
    pages = Pages.stored(rows, levels)
    n = int(pages.sizes.sum())
    page = np.repeat(np.arange(len(rows)), pages.sizes)
    leaves = np.frombuffer(b"".join(r["leaves"] for r in rows), np.uint8).reshape(-1, WIDTH)
    new = np.frombuffer(b"".join(c if c is not None else r["leaves"][i * WIDTH:(i + 1) * WIDTH] for r in rows for i, c in enumerate(r["changed"])),
                        np.uint8).reshape(-1, WIDTH)
    tops = pages.fold(new, np.arange(n))
    # rows of a page whose tops are equal share the steps above it: each distinct top is folded once
    keyed = np.concatenate((page.astype(">i8")[:, None].view(np.uint8), tops), axis=1)
    _, first, same = np.unique(np.ascontiguousarray(keyed).view(f"V{8 + WIDTH}").ravel(), return_index=True, return_inverse=True)
    folded = fold_steps(tops[first], [read_steps(r["path"]) for r in rows], page[first])
    folded = [folded[i].tobytes().hex() for i in range(len(folded))]
    # proofs: siblings of the page's levels, then those of the steps above
    above = [b"".join(s[3].tobytes() for s in read_steps(r["path"])).hex().encode() for r in rows]
    digits = [(nodes.tobytes().hex().encode(), first_of, count, run) for nodes, first_of, count, _, run in pages.levels]
    proofs = []
    for node, p in enumerate(page.tolist()):
        h = hashlib.sha256()
        for text, first_of, count, run in digits:
            up = run[node]
            lo = first_of[up]
            h.update(text[64 * lo:64 * node])
            h.update(text[64 * node + 64:64 * (lo + count[up])])
            node = int(up)
        h.update(above[p])
        proofs.append(h.hexdigest())
    result = [folded[i] for i in same]
    return pa.RecordBatch.from_arrays(
        [pa.array([d for r in rows for d in r["doc_ids"]], pa.int64()), pa.array([x.tobytes().hex() for x in leaves], pa.string()),
         pa.array([rows[p]["subroot"].hex() for p in page], pa.string()), pa.array([root] * n, pa.string()), pa.array(proofs, pa.string()),
         pa.array(result, pa.string()), pa.array([x == root for x in result], pa.bool_())],
        names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
