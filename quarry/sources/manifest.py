"""Repository manifest.

The manifest is a table ``repos(tier, name, url, language, approximate_loc,
weight, branch, depth, license, description, notes)`` read from JSON or
Parquet with an explicit schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import text as TX

REPOS_SCHEMA = T.StructType([
    T.StructField("tier", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("language", T.StringType()),
    T.StructField("approximate_loc", T.LongType()), T.StructField("weight", T.IntegerType()),
    T.StructField("branch", T.StringType()), T.StructField("depth", T.IntegerType()),
    T.StructField("license", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("notes", T.StringType()),
])


def read_manifest(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    reader = spark.read.schema(REPOS_SCHEMA)
    if fmt == "json":
        reader = reader.option("mode", "FAILFAST").option("multiLine", "true")
    return reader.format(fmt).load(path)


#: Key of a tier's list in a nested manifest: the tier's name and this.
TIER_SUFFIX = "_repos"


def repos_from_json(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repos, rejected) of nested manifests ``texts(file, value)``: an object
    whose ``<tier>_repos`` are lists of repositories, beside other settings.

    The documents are read as VARIANT, so what else they hold needs no schema;
    tiers and entries are exploded to rows and each field is taken by its path.
    A text that is no JSON, a tier that is no list and an entry without name or
    url are rows of ``rejected(file, tier, error)``; a field of another type is null."""
    v = texts.select("file", F.try_parse_json("value").alias("v"))
    tvf = texts.sparkSession.tvf
    tiers = (v.filter("v is not null").lateralJoin(tvf.variant_explode(F.col("v").outer())).filter(F.col("key").endswith(TIER_SUFFIX))
             .select("file", F.expr(f"left(key, length(key) - {len(TIER_SUFFIX)})").alias("tier"), F.col("value").alias("entries")))
    listed = F.schema_of_variant("entries").startswith("ARRAY")
    rows = (tiers.filter(listed).lateralJoin(tvf.variant_explode(F.col("entries").outer()))
            .select("file", "tier", *[F.try_variant_get("value", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in REPOS_SCHEMA if f.name != "tier"]))
    whole = F.col("name").isNotNull() & F.col("url").isNotNull()
    rejected = (v.filter("v is null").select("file", F.lit(None).cast("string").alias("tier"), F.lit("no JSON document").alias("error"))
                .unionByName(tiers.filter(~listed).select("file", "tier", F.lit("the tier is no list").alias("error")))
                .unionByName(rows.filter(~whole).select("file", "tier", F.lit("a repository needs a name and a url").alias("error"))))
    return rows.filter(whole).select("file", *REPOS_SCHEMA.names), rejected


def read_nested_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``repos_from_json`` of whole files."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return repos_from_json(texts)


def license_rollup(repos: DataFrame) -> DataFrame:
    """Repositories, lines and weight per licence and tier, with totals per
    licence and over all (ROLLUP); a missing licence is ``unknown``."""
    named = repos.withColumn("license", F.coalesce("license", F.lit("unknown")))
    return named.rollup("license", "tier").agg(F.count(F.lit(1)).alias("repos"), F.sum("approximate_loc").alias("approximate_loc"), F.sum("weight").alias("weight"))


def load_repository_config(repos: DataFrame, core_only: bool = True) -> DataFrame:
    """Core tier, or core then extended (xl is never read); depth
    defaults to 1; folder is ``src/<name>/`` (F45)."""
    core = repos.filter(F.col("tier") == "core")
    sel = core if core_only else core.unionByName(repos.filter(F.col("tier") == "extended"))
    return sel.select("name", "url", F.coalesce("depth", F.lit(1)).alias("depth"),
                      TX.folder_of("name").alias("folder"), "tier", "language")


def missing_repos(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows without any file (must be empty)."""
    return manifest.join(files.select(F.col("repo").alias("name")).distinct(), "name", "left_anti")


def manifest_rollup(repos: DataFrame) -> DataFrame:
    """LoC, weight and repository counts per tier and language, with
    per-tier and grand totals (ROLLUP)."""
    return (repos.rollup("tier", "language")
            .agg(F.count(F.lit(1)).alias("repos"), F.sum("approximate_loc").alias("approximate_loc"),
                 F.sum("weight").alias("weight")))
