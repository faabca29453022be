import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quarry.session import get_spark
    s = get_spark(master="local[*]", shuffle_partitions=8)
    yield s


def files_df(spark, rows):
    """files table from (path, content) pairs; repo = second path part."""
    from pyspark.sql import functions as F

    from quarry.sources.corpus import finish_files
    df = spark.createDataFrame(rows, "path string, content string")
    df = (df.withColumn("repo", F.split("path", "/").getItem(1))
            .withColumn("rel_path", F.expr("substring(path, length(concat('src/', repo, '/')) + 1)")))
    return finish_files(df.select("repo", "path", "rel_path", "content"))
