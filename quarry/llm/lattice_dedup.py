"""Embedding near-dedup by lattice hashing, verified by cosine.

Each of ``TABLES`` tables projects a unit vector at random to ``POINTS`` times
eight dimensions and decodes every eight to the nearest point of the E8
lattice; the points are the vector's home cell.  The ``PROBES`` next
combinations of near points are the cells it probes.  Vectors meet where the
home cell of one is the home or a probed cell of the other.

Equal vectors form a class first.  Cells are packed into blocks of about
``BLOCK`` vectors (a hot cell has many), blocks of a cell meet in pairs, and a
task multiplies two blocks at a time.  A pair that shares home cells is counted
in the first such table only, so what leaves a block are sums per vector and
edges to the least vector of each linked part, not pairs; only pairs that met
by probing alone go on as pairs and are made distinct.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null vec_id, link with nothing; vectors of
different length don't meet; repeated rows of one vec_id count once; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, connected_components, map_batches, mix64

TABLES, POINTS, PROBES = 6, 2, 8
#: Length of a lattice unit in standard deviations of a projection of a unit vector.
SCALE = 2.4
BLOCK = 256
NEAREST = 4  # near lattice points considered for each eight dimensions

VECTOR_SCHEMA = "vec_id long, norm_key_a long, norm_key_b long, v binary, homes array<long>, probes array<long>"


def near_points(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances, points) of ``n`` near points of E8 for each row of
    ``x``; the first is the nearest.  E8 is D8, the integer points of even sum,
    and D8 shifted by a half.  Rounding gives an integer point; where its sum
    is odd an odd number of the coordinates worst rounded are turned the other
    way, else an even number."""
    found = []
    for shift in (0.0, 0.5):
        base = np.rint(x - shift)
        off = x - shift - base
        worst = np.argsort(-np.abs(off), axis=1, kind="stable")
        odd = base.sum(axis=1).astype(np.int64) % 2 != 0
        rows = np.arange(len(x))
        for turned in ((), (0,), (1,), (2,), (3,), (0, 1), (0, 2), (1, 2), (0, 3)):
            point = base.copy()
            for k in turned:
                at = worst[:, k]
                point[rows, at] += np.where(off[rows, at] >= 0, 1, -1)
            d = np.square(x - shift - point).sum(axis=1)
            d[(len(turned) % 2 == 1) != odd] = np.inf
            found.append((d, point + shift))
    d, p = np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)
    order = np.argsort(d, axis=1, kind="stable")[:, :n]
    return np.take_along_axis(d, order, 1), np.take_along_axis(p, order[:, :, None], 1)


def cells(unit: np.ndarray) -> np.ndarray:
    """(row, table, 1 + PROBES) cell keys; the first of a table is the home cell."""
    dim = unit.shape[1]
    out = np.empty((len(unit), TABLES, 1 + PROBES), dtype=np.uint64)
    choices = np.array(list(itertools.product(range(NEAREST), repeat=POINTS)))
    for t in range(TABLES):
        y = unit @ np.random.default_rng(1000 * t + dim).normal(0, 1 / SCALE, (dim, 8 * POINTS))
        parts = [near_points(y[:, 8 * k:8 * k + 8], NEAREST) for k in range(POINTS)]
        total = sum(parts[k][0][:, choices[:, k]] for k in range(POINTS))
        order = np.argsort(total, axis=1, kind="stable")[:, :1 + PROBES]
        key = np.full(order.shape, t * 1_000_003 + dim, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(POINTS):
                point = np.take_along_axis(parts[k][1], choices[order][:, :, k][:, :, None], 1)
                for c in range(8):
                    key = mix64(key * np.uint64(31) + (2 * point[:, :, c]).astype(np.int64).view(np.uint64))
        out[:, t] = key
    return out


def _vectors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 3 + [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["vec_id", "norm_key_a", "norm_key_b", "v", "homes", "probes"]
    for b in it:
        raw = b.column("embedding").to_pylist()
        cols = [b.column("vec_id").to_pylist()] + [[None] * b.num_rows for _ in range(5)]
        by_dim: dict[int, list[int]] = {}
        for i, e in enumerate(raw):
            if e and cols[0][i] is not None and None not in e and np.isfinite(e).all() and any(e):
                by_dim.setdefault(len(e), []).append(i)
        for at in by_dim.values():
            x = np.array([raw[i] for i in at], dtype=np.float64) + 0.0     # turns -0.0 into 0.0
            # scaled first, so that squares neither vanish nor overflow
            unit = x / np.abs(x).max(axis=1, keepdims=True)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            key = cells(unit).view(np.int64)
            with np.errstate(over="ignore"):
                bits = mix64(x.view(np.uint64) + np.arange(x.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                ka, kb = bits.sum(axis=1, dtype=np.uint64), mix64(bits ^ np.uint64(0x5851F42D4C957F2D)).sum(axis=1, dtype=np.uint64)
            for j, i in enumerate(at):
                cols[1][i], cols[2][i] = int(ka[j].view(np.int64)), int(kb[j].view(np.int64))
                cols[3][i], cols[4][i], cols[5][i] = unit[j].tobytes(), key[j, :, 0], key[j, :, 1:].ravel()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def _members(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows = column.as_py()
    return (np.array([r["rep"] for r in rows]), np.array([r["n"] for r in rows]),
            np.frombuffer(b"".join(r["v"] for r in rows), np.float64).reshape(len(rows), -1),
            np.array([r["homes"] for r in rows]))


def _parts(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges (vector, least vector of its linked part) of one block pair."""
    la, lb = a.copy(), b.copy()
    top = np.iinfo(np.int64).max
    while True:
        na = np.minimum(la, np.where(linked, lb[None, :], top).min(axis=1, initial=top))
        nb = np.minimum(lb, np.where(linked, na[:, None], top).min(axis=0, initial=top))
        if (na == la).all() and (nb == lb).all():
            return list({*zip(a[a != la].tolist(), la[a != la].tolist()), *zip(b[b != lb].tolist(), lb[b != lb].tolist())})
        la, lb = na, nb


def _meet(least: float):
    """Multiplies two blocks of a row.  Out: kind 0 (x, sum of links), kind 1
    (edge x, y), kind 2 (pair x, y that shares no home cell)."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out: list[tuple] = []
            for left, right, table, same in zip(batch.column("left"), batch.column("right"), batch.column("t").to_pylist(), batch.column("same").to_pylist()):
                (ia, na, va, ha), (ib, nb, vb, hb) = _members(left), _members(right)
                near = va @ vb.T >= least
                near &= ia[:, None] != ib[None, :]
                if not near.any():
                    continue
                i, j = np.nonzero(near)
                shared = ha[i] == hb[j]
                if table is None:                 # met by probing
                    alone = ~shared.any(axis=1)
                    out += zip(itertools.repeat(2), np.minimum(ia[i], ib[j])[alone].tolist(), np.maximum(ia[i], ib[j])[alone].tolist())
                    continue
                first = shared.argmax(axis=1) == table
                linked = np.zeros_like(near)
                linked[i[first], j[first]] = True
                out += [(0, x, s) for x, s in zip(ia.tolist(), (linked @ nb).tolist()) if s]
                if not same:
                    out += [(0, x, s) for x, s in zip(ib.tolist(), (na @ linked).tolist()) if s]
                out += [(1, x, y) for x, y in _parts(linked, ia, ib)]
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["kind", "x", "y"])
    return run


def _blocks(slots: DataFrame) -> DataFrame:
    """Members of (cell, t) in blocks of about BLOCK, by a hash of their id."""
    count = slots.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    return (slots.join(count, "cell").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
            .groupBy("cell", "t", "block").agg(F.collect_list(F.struct("rep", "n", "v", "homes")).alias("members")))


def components(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "lattice")
    rows = scratch.save(map_batches(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")),
                                    _vectors, VECTOR_SCHEMA), "vectors")
    classes = (rows.where("v is not null").groupBy("norm_key_a", "norm_key_b")
               .agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("n"), F.first("v").alias("v"),
                    F.first("homes").alias("homes"), F.first("probes").alias("probes")))
    classes = scratch.save(classes, "classes")
    member = ("rep", "n", "v", "homes")
    home = scratch.save(_blocks(classes.select(*member, F.posexplode("homes").alias("t", "cell"))), "home")
    # probes into cells that nobody lives in are dropped by ids alone, before vectors are attached
    asked = classes.select("rep", F.explode("probes").alias("cell")).join(home.select("cell").distinct(), "cell", "left_semi")
    asked = asked.join(classes.select(*member), "rep").withColumn("t", F.lit(-1))
    probe = scratch.save(_blocks(asked), "probe")
    right = home.select("cell", F.col("block").alias("other"), F.col("members").alias("right"))
    at_home = (home.join(right, "cell").where("block <= other")
               .select(F.col("members").alias("left"), "right", "t", (F.col("block") == F.col("other")).alias("same")))
    by_probe = probe.join(right, "cell").select(F.col("members").alias("left"), "right", F.lit(None).cast("int").alias("t"), F.lit(False).alias("same"))
    met = scratch.save(map_batches(at_home.union(by_probe), _meet(least), "kind long, x long, y long"), "met")
    pairs = scratch.save(met.where("kind = 2").select("x", "y").distinct(), "pairs")
    sizes = classes.select(F.col("rep").alias("other"), "n")
    ends = pairs.union(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    counts = (met.where("kind = 0").select("x", F.col("y").alias("links"))
              .union(ends.join(sizes, F.col("y") == F.col("other")).select("x", F.col("n").alias("links")))
              .groupBy("x").agg(F.sum("links").alias("links")))
    edges = scratch.save(met.where("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b")).union(pairs.toDF("a", "b")).distinct(), "edges")
    parts = connected_components(edges, scratch, "cc")
    found = (classes.select("norm_key_a", "norm_key_b", "rep", "n")
             .join(counts, F.col("rep") == F.col("x"), "left").join(parts, F.col("rep") == F.col("node"), "left")
             .select("norm_key_a", "norm_key_b", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("part")))
    out = rows.select("vec_id", "norm_key_a", "norm_key_b").join(found, ["norm_key_a", "norm_key_b"], "left")
    return (out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("part", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
