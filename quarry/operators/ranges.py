"""Lines of files that lie in ranges (J6): an interval join over buckets.

A range is cut into the buckets of ``BUCKET`` lines that it touches, a line
lies in one bucket, and both meet in an equi-join on (path, bucket); the exact
bounds are checked after it.  A file of any length is thus spread over as many
keys as it has buckets, and a range costs its length / BUCKET rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as TX
from quarry.operators.joins import join_small

BUCKET = 64


def numbered_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line) from 1; the empty end after a last line feed is no line."""
    lines = TX.split_lines("content")
    whole = F.when(F.col("content").endswith("\n"), F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    return files.select("path", F.posexplode(whole).alias("i", "line")).select("path", (F.col("i") + 1).alias("line_no"), "line")


def lines_in_ranges(ranges: DataFrame, files: DataFrame) -> DataFrame:
    """``ranges(path, first_line, last_line, ...)`` with each line they hold
    (line_no, line).  Only files that have a range are read by lines; a range
    whose end lies before its beginning holds none."""
    bucket = lambda c: F.floor(F.col(c) / BUCKET)
    cut = ranges.filter("first_line <= last_line").withColumn("bucket", F.explode(F.sequence(bucket("first_line"), bucket("last_line"))))
    lines = numbered_lines(join_small(files.select("path", "content"), ranges.select("path").distinct(), "path", "left_semi"))
    met = lines.withColumn("bucket", bucket("line_no")).join(cut, ["path", "bucket"])
    return met.filter("line_no between first_line and last_line").drop("bucket").select(*ranges.columns, "line_no", "line")
