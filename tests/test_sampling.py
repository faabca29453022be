from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import sampling as S


def test_w2_counts(spark):
    rows = [(g, f"p{i}") for g, n in [("a", 0), ("b", 1), ("c", 2), ("d", 5), ("e", 13)] for i in range(n)]
    df = spark.createDataFrame(rows, "g string, path string")
    got = {r["g"]: r["n"] for r in S.sample_per_group(df, "g", "path", p=0.6).groupBy("g").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"c": 1, "d": 3, "e": 7}


def test_exact_rank_matches_row_number_and_is_partition_independent(spark):
    df = spark.range(0, 3000).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").alias("k"))
    h = df.withColumn("h", S.hash_key(42, "t", "g", "k"))
    ref = {(r["g"], r["k"]): r["r"] for r in h.withColumn(
        "r", F.row_number().over(Window.partitionBy("g").orderBy("h", "k"))).collect()}
    for parts in (1, 3, 7):
        got = {(r["g"], r["k"]): r["rank"] for r in S.exact_rank(h.repartition(parts), ["g"], "h", ["k"],
                                                                  bucket_chars=1).collect()}
        assert got == ref


def test_sample_fraction_is_deterministic(spark):
    df = spark.range(0, 500).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("symbol"))
    a, k = S.sample_fraction(df.repartition(1), "symbol", 0.05)
    b, _ = S.sample_fraction(df.repartition(7), "symbol", 0.05)
    assert k == 25
    assert sorted(r["symbol"] for r in a.collect()) == sorted(r["symbol"] for r in b.collect())
    one, k1 = S.sample_fraction(df.limit(3), "symbol", 0.05)
    assert k1 == 1 and one.count() == 1                # max(1, int(n*p))


def test_large_k_path_equals_top_k_path(spark, monkeypatch):
    df = spark.range(0, 400).select(F.col("id").cast("string").alias("key"))
    small = {r["key"]: r["rank"] for r in S.sample_n(df, "key", 50, op="x").collect()}
    monkeypatch.setattr(S, "TOP_K_LIMIT", 10)
    big = {r["key"]: r["rank"] for r in S.sample_n(df, "key", 50, op="x").collect()}
    assert small == big
