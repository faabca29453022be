"""File-system scan into ``files``.

``binaryFile`` lists and reads the tree in parallel; the extension glob is
pushed into the listing (``pathGlobFilter``), directory/name exclusions are
filters on ``path`` evaluated before ``content`` is decoded, and the content
column is only read when selected.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as TX
from quarry.sources.corpus import FILES_COLUMNS, finish_files

SOURCE_GLOB = "*.{" + ",".join(TX.SOURCE_EXTS) + "}"


def _exists(spark: SparkSession, root: str) -> bool:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(path))


def under_root(spark: SparkSession, root: str) -> F.Column:
    """The part of a listed file's ``path`` below ``root``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return F.expr(f"substring(path, {len(full) + 2})")


def scan_sources(spark: SparkSession, roots: list[str], glob: str = SOURCE_GLOB) -> DataFrame:
    """Source files below each root; every sub-directory of a root is
    a repository (S3); missing roots are skipped.  Paths are given relative
    to the root's parent, as the reference lists ``src/<repo>/...``."""
    frames = []
    for root in roots:
        if not _exists(spark, root):
            continue
        base = os.path.basename(root.rstrip("/"))
        raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
               .option("pathGlobFilter", glob).load(root))
        df = (raw.withColumn("under", under_root(spark, root))
              .filter(F.col("under").contains("/"))                       # files inside a repo dir
              .withColumn("path", F.concat(F.lit(base + "/"), F.col("under")))
              .withColumn("repo", F.substring_index("under", "/", 1))
              .withColumn("rel_path", F.expr("substring(under, length(repo) + 2)"))
              .filter(TX.is_scanned("path"))
              .withColumn("content", TX.decode_text("content")))
        frames.append(df.select("repo", "path", "rel_path", "content"))
    if not frames:
        return spark.createDataFrame([], "repo string, path string, rel_path string, ext string, language string, "
                                         "content string, size_bytes long, line_count int, sha string, read_error string")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return finish_files(out).select(*FILES_COLUMNS)


def discover_repos(files: DataFrame) -> DataFrame:
    """S3: distinct repositories of a files table."""
    return files.select("repo").distinct()
