"""Quality rules: robust multivariate outliers per language and source.

Every text becomes a vector of transformed statistics.  For each (language,
source) group a minimum-covariance-determinant estimate (the mean and
covariance of the three quarters of the rows that lie closest) is found by
C-steps; a row is rejected when its squared Mahalanobis distance is above the
cut.  A C-step is one pass: rows meet the current estimates of their group in
a salted equi-join (a hot group is spread over ``SALTS`` keys), distances fall
in bins, and each (group, bin) sums counts and products before the shuffle.
The estimates of the next step follow from the bins up to the coverage, so no
group is ever collected or sorted.

Defined results: null text counts as empty (no words, base rule fails); null
language or source is a group of its own; groups under ``MIN_ROWS`` rows use
their language's estimates, and languages under it reject nothing by the
method; rows failing the base rules take no part in the estimates; repeated
rows are judged one by one; an empty table gives an empty result; columns
other than doc_id, text, lang and source are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, map_batches, text_key, unused

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words")
STATS_SCHEMA = "doc_id long, lang string, source string, row_key long, " + ", ".join(f"{c} long" for c in STATS)

#: Coordinates of the vector and the least standard deviation each may have.
FLOORS = (0.35, 0.45, 0.12, 0.06, 0.10)
P = len(FLOORS)
COVERAGE = 0.75
#: 0.75 / P(chi2 with P + 2 degrees <= the 0.75 quantile of chi2 with P degrees): makes the estimate consistent.
CONSISTENCY = 1.41
C_STEPS = 4
#: Squared distance above which a row is rejected: far beyond the chi-square
#: quantiles, since short texts scatter more than the bulk that is estimated.
CUT = 75.0
MIN_ROWS = 40
SALTS = 32
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def text_stats(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of ``STATS``."""
    text = text or ""
    words = WORD.findall(text)
    n_dup, n_lines, seen = 0, 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            n_lines += 1
            n_dup += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = {w for w, n in Counter(windows).items() if n > 1}
        reach = -1
        for i, w in enumerate(windows):
            if w in often:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), n_dup, repeated, n_lines,
            sum(w.isupper() and len(w) > 1 for w in words))


def _stats_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [text_stats(t) for t in b.column("text").to_pylist()]
        cols = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(STATS)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("source"), b.column("row_key"), *cols],
                                         names=["doc_id", "lang", "source", "row_key", *STATS])


def statistics(docs: DataFrame) -> DataFrame:
    """One row of counts per document; whole texts, one pass."""
    slim = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"), F.col("source").cast("string"),
                       text_key().alias("row_key"))
    return map_batches(slim, _stats_batches, STATS_SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [F.log1p(100 * F.col("n_symbols") / n), F.col("word_chars") / n,
            F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
            F.col("n_repeat_words") / n, F.sqrt(F.col("n_upper_words") / n)]


def _inverse(cov: np.ndarray) -> np.ndarray:
    return np.linalg.inv(cov + np.diag(np.square(FLOORS)))


def _parameters(mean: np.ndarray, cov: np.ndarray, n: int) -> dict:
    inv = _inverse(cov)
    return {"n": int(n), **{f"m{i}": float(mean[i]) for i in range(P)}, **{f"v{i}_{j}": float(inv[i, j]) for i, j in _PAIRS}}


PARAM_SCHEMA = ("grp string, n long, " + ", ".join(f"m{i} double" for i in range(P)) + ", "
                + ", ".join(f"v{i}_{j} double" for i, j in _PAIRS))


def _start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame([{"grp": r["grp"]} | _parameters(
            np.array([r[f"q{i}"][1] for i in range(P)]),
            np.diag([((r[f"q{i}"][2] - r[f"q{i}"][0]) / 1.349) ** 2 for i in range(P)]), r["n"])
            for r in pdf.to_dict("records")], columns=[c.split()[0] for c in PARAM_SCHEMA.split(", ")])


def _c_step(bins: pd.DataFrame) -> pd.DataFrame:
    """Estimates from a group's bins (at most BINS rows) up to the coverage."""
    bins = bins.sort_values("bin")
    total = int(bins["n"].sum())
    reach = int(np.searchsorted(bins["n"].cumsum().to_numpy(), COVERAGE * total)) + 1
    near = bins.iloc[:reach]
    n = int(near["n"].sum())
    mean = np.array([near[f"s{i}"].sum() / n for i in range(P)])
    cov = np.zeros((P, P))
    for i, j in _PAIRS:
        cov[i, j] = cov[j, i] = near[f"s{i}_{j}"].sum() / n - mean[i] * mean[j]
    return pd.DataFrame([{"grp": bins["grp"].iloc[0]} | _parameters(mean, cov * CONSISTENCY, total)])


#: Distance bins: eighths of an octave, so a bin's width is 9 % of its distance.
BINS = 320


def _distance() -> Column:
    d = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(P)]
    return sum((d[i] * d[j] * F.col(f"v{i}_{j}") * (1 if i == j else 2) for i, j in _PAIRS), F.lit(0.0))


def _meet(rows: DataFrame, params: DataFrame) -> DataFrame:
    salted = params.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row_key"), F.lit(SALTS)).cast("int")).join(salted, ["grp", "salt"])


def _group_keys() -> Column:
    mark = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null")) for c in ("lang", "source")]
    return F.array(F.concat(mark[0], F.lit("\t"), mark[1]), mark[0])


def judge(docs: DataFrame) -> DataFrame:
    """Statistics of every document with base_failed, its squared distance
    (null where the method does not judge) and kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality-rules")
    stats = scratch.save(statistics(docs), "stats")
    rows = (stats.where(~base_failed())
            .select("doc_id", "row_key", _group_keys().alias("keys"), *[x.alias(f"x{i}") for i, x in enumerate(_vector())]))
    # level 0: the language and source, level 1: the language
    both = rows.select("doc_id", "row_key", F.posexplode("keys").alias("level", "grp"), *[f"x{i}" for i in range(P)])
    both = scratch.save(both, "vectors")
    start = both.groupBy("grp").agg(F.count("*").alias("n"), *[
        F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 2000).alias(f"q{i}") for i in range(P)])
    params = scratch.save(start.mapInPandas(_start, PARAM_SCHEMA), "params0")
    for k in range(C_STEPS):
        met = _meet(both, params).withColumn("bin", F.least(F.greatest(F.floor(8 * F.log2(_distance() + 1e-6)) + 160, F.lit(0)), F.lit(BINS - 1)))
        bins = met.groupBy("grp", "bin").agg(F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(P)],
                                             *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in _PAIRS])
        params = scratch.save(bins.groupBy("grp").applyInPandas(_c_step, PARAM_SCHEMA), f"params{k + 1}")
    far = _meet(both, params.where(F.col("n") >= MIN_ROWS)).select("doc_id", "row_key", "level", _distance().alias("d"))
    # the own group's distance where it has one, else the language's
    far = far.groupBy("doc_id", "row_key").agg(F.min_by("d", "level").alias("distance"))
    far = far.select(F.col("doc_id").alias("id_"), F.col("row_key").alias("key_"), "distance")
    out = stats.join(far, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("row_key") == F.col("key_")), "left").drop("id_", "key_")
    return (out.withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUT)))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns unchanged."""
    key, bad_id, bad_key = (unused(c, docs) for c in ("row_key_", "bad_id_", "bad_key_"))
    bad = judge(docs).where(~F.col("kept")).select(F.col("doc_id").alias(bad_id), F.col("row_key").alias(bad_key)).distinct()
    keyed = docs.withColumn(key, text_key())
    return keyed.join(bad, keyed["doc_id"].eqNullSafe(bad[bad_id]) & (keyed[key] == bad[bad_key]), "left_anti").drop(key)
