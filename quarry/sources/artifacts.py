"""Artifact tables in and out.

The reference keeps its records as JSON objects keyed by name; here they are
tables, written with Spark's writers.  ``map_from_entries`` rebuilds the
keyed-object shape where a caller needs it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_artifact(spark: SparkSession, path: str, value_type: T.DataType = T.StringType()) -> DataFrame:
    """JSON objects ``{key: value}``, indented or one per line -> rows
    (key, value); a missing path gives an empty table of that schema, a
    malformed file fails."""
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", value_type)])
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    # an object that begins on a line of its own, after the end of another, stands alone
    objects = F.explode(F.split(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")), r"(?<=\})\s*\n(?=\{)"))
    raw = spark.read.text(path, wholetext=True).select(objects.alias("value")).where("value <> ''")
    m = F.from_json("value", T.MapType(T.StringType(), value_type), {"mode": "FAILFAST"})
    return raw.select(F.explode(m).alias("key", "value"))


def read_json_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tasks or truth rows with an explicit schema; malformed rows are
    kept with ``_corrupt_record`` set, so they can be logged and skipped."""
    s = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    return (spark.read.schema(s).option("mode", "PERMISSIVE").option("multiLine", "true")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def as_keyed_object(df: DataFrame, key: str, value_cols: list[str]) -> DataFrame:
    """One-row ``MAP<key, STRUCT>`` in the reference's JSON-object shape
    (only for bounded record tables such as the transform records)."""
    return df.agg(F.map_from_entries(F.collect_list(
        F.struct(F.col(key), F.struct(*value_cols)))).alias("record"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Overwrite a table folder (a new corpus version is a new
    folder; nothing is changed in place)."""
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_tasks_truth(tasks: DataFrame, truths: DataFrame, path: str, target_col: str = "target") -> None:
    """Truth rows routed to a folder per target (``partitionBy``), the
    tasks, and their summary: the total and the distinct types as one document
    and (id, type) of every task as rows."""
    from quarry.functions.text import task_type_of
    from quarry.operators.tasks import truth_target
    kind = F.col("type") if "type" in tasks.columns else task_type_of("task_id")
    listed = tasks.select(F.col("task_id").alias("id"), kind.alias("type"))
    total = listed.agg(F.count(F.lit(1)).alias("total_tasks"), F.sort_array(F.collect_set("type")).alias("task_types"))
    total.coalesce(1).write.mode("overwrite").json(path + "/task_summary")
    listed.write.mode("overwrite").json(path + "/task_summary_tasks")
    truths.withColumn(target_col, truth_target("task_id")).write.mode("overwrite").partitionBy(target_col).json(path + "/truth")
    tasks.write.mode("overwrite").json(path + "/tasks")


def write_report(report_json: DataFrame, path: str) -> None:
    """One JSON document per submission."""
    report_json.select("json").write.mode("overwrite").text(path)
