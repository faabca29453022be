"""Seeded, stateless sampling.

Every choice is a function of ``md5(seed:op:key)``: independent of
partitioning, of task order and of re-execution after an executor loss.

``exact_rank`` ranks rows by that hash inside groups without sorting a whole
group in one task: rows are first split into (group, hash-prefix) buckets,
ranked locally, and shifted by the sizes of the earlier buckets of the same
group.  A key that holds a third of all rows is therefore spread over up to
``16**bucket_chars`` tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Samples up to this size are taken with TakeOrderedAndProject (k rows per
# task, one merge of k rows); above it the bucketed exact rank is used.
TOP_K_LIMIT = 10_000


def hash_key(seed: int, op: str, *keys) -> Column:
    """K6: hex md5 of ``seed:op:key...``; lexical order == numeric order."""
    parts = [F.lit(str(seed)), F.lit(op)] + [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def hash_int(h: Column, start: int, length: int = 8) -> Column:
    """Integer from ``length`` hex digits of a hex hash (1-based start)."""
    return F.conv(F.substring(h, start, length), 16, 10).cast("long")


def exact_rank(df: DataFrame, by: list[str], order_col: str, tie_cols: list[str] | None = None,
               bucket_chars: int = 3, rank_col: str = "rank", size_col: str | None = "group_size") -> DataFrame:
    """1-based rank of each row by ``order_col`` (a hex hash) within ``by``.

    Also returns the group size when ``size_col`` is set.  Plan: one shuffle
    on (by, bucket) for the local rank and bucket sizes, a small window over
    the bucket-size table, and a join back on (by, bucket).
    """
    tie_cols = tie_cols or []
    b = "_qbucket"
    local = df.withColumn(b, F.substring(F.col(order_col), 1, bucket_chars))
    w_local = Window.partitionBy(*by, b).orderBy(F.col(order_col), *[F.col(c) for c in tie_cols])
    local = local.withColumn("_qlocal", F.row_number().over(w_local))
    sizes = local.groupBy(*by, b).agg(F.count(F.lit(1)).alias("_qn"))
    w_prev = (Window.partitionBy(*by).orderBy(b)
              .rowsBetween(Window.unboundedPreceding, -1))
    offs = sizes.withColumn("_qoff", F.coalesce(F.sum("_qn").over(w_prev), F.lit(0)))
    cols = [*by, b, "_qoff"]
    if size_col:
        offs = offs.withColumn(size_col, F.sum("_qn").over(Window.partitionBy(*by)).cast("long"))
        cols.append(size_col)
    out = local.join(offs.select(*cols), [*by, b])
    out = out.withColumn(rank_col, (F.col("_qoff") + F.col("_qlocal")).cast("long"))
    return out.drop(b, "_qlocal", "_qoff")


def _k_of(n: int, p: float, min1: bool) -> int:
    k = int(n * p)
    return max(1, k) if min1 else k


def sample_fraction(df: DataFrame, key: str, p: float, seed: int = 42, op: str = "",
                    min1: bool = True, n: int | None = None) -> tuple[DataFrame, int]:
    """K1: ``max(1, int(n*p))`` distinct keys without replacement.

    Returns (sample with a 1-based ``rank`` column = sample order, k).  ``n``
    is one count job unless given.
    """
    keys = df.select(key).distinct()
    if n is None:
        n = keys.count()
    k = min(_k_of(n, p, min1), n)
    return sample_n(keys, key, k, seed, op), k


def sample_n(df: DataFrame, key: str, k: int, seed: int = 42, op: str = "") -> DataFrame:
    """K2/K3: ``min(k, n)`` keys, the ``k`` smallest hashes, with ``rank``."""
    h = "_qh"
    hashed = df.withColumn(h, hash_key(seed, op, key))
    if k <= TOP_K_LIMIT:
        top = hashed.orderBy(F.col(h), F.col(key)).limit(k)
        w = Window.orderBy(F.col(h), F.col(key))  # k rows at most
        return top.withColumn("rank", F.row_number().over(w).cast("long")).drop(h)
    ranked = exact_rank(hashed, [], h, [key], bucket_chars=4, size_col=None)
    return ranked.filter(F.col("rank") <= k).drop(h)


def sample_per_group(df: DataFrame, group: list[str] | str, key: str, n: int | None = None,
                     p: float | None = None, seed: int = 42, op: str = "",
                     ) -> DataFrame:
    """Per group keep ``min(n, size)`` rows or ``int(size*p)`` rows.

    ``int(size*p)`` is computed in double precision, as Python does.
    """
    by = [group] if isinstance(group, str) else list(group)
    h = "_qh"
    hashed = df.withColumn(h, hash_key(seed, op, *by, key))
    ranked = exact_rank(hashed, by, h, [key])
    if n is not None:
        limit = F.least(F.lit(n), F.col("group_size"))
    else:
        limit = F.floor(F.col("group_size").cast("double") * F.lit(float(p))).cast("long")
    return ranked.withColumn("take_n", limit).filter(F.col("rank") <= F.col("take_n")).drop(h)


def shard_of(key, n_shards: int) -> Column:
    """Shard number of a key (md5 based, so SQL engines agree)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.pmod(hash_int(F.md5(k.cast("string")), 1, 15), F.lit(n_shards)).cast("int")


def shard_select(df: DataFrame, key: str, shard: int, n_shards: int) -> DataFrame:
    """Process shard ``shard`` of ``n_shards``."""
    return df.filter(shard_of(key, n_shards) == shard)
