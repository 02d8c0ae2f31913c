"""Writers. Parquet is the native form; the others keep the file formats that the stages exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def nested_json(df: DataFrame, path: str, keys: list[str], value: str) -> None:
    """SNK1: one JSON object, keyed by one or two columns, in one file. A report's size, not a table's: the object is one row."""

    def entries(key: str, item: str) -> Column:  # sorted by key only, as maps have no order
        pairs = F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col(item).alias("v")))
        return F.map_from_entries(F.array_sort(pairs, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)))

    if len(keys) == 1:
        top = df.groupBy().agg(entries(keys[0], value).alias("m"))
    else:
        inner = df.groupBy(keys[0]).agg(entries(keys[1], value).alias("_inner"))
        top = inner.groupBy().agg(entries(keys[0], "_inner").alias("m"))
    top.select(F.to_json("m").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def append_jsonl(df: DataFrame, path: str, unit: str | None = None) -> None:
    """SNK2: a JSON object per row, appended; by unit into folders, so that a unit can be found or replaced."""
    writer = df.write.mode("append")
    (writer.partitionBy(unit) if unit else writer).json(path)


def write_csv(df: DataFrame, path: str, index: str | None = None) -> None:
    """SNK3: with a header, texts quoted so that they read back; with index, a leading unnamed position from that column."""
    out = df.select(F.col(index).alias(""), *(c for c in df.columns if c != index)) if index else df
    out.write.mode("overwrite").options(header=True, escape='"', quoteAll=True).csv(path)


def by_extension(df: DataFrame, path: str) -> None:
    """SNK4: .csv is CSV, anything else JSON rows."""
    if path.endswith(".csv"):
        write_csv(df, path)
    else:
        df.write.mode("overwrite").json(path)


def write_bank(df: DataFrame, path: str) -> None:
    """SNK5: exemplars by movie, so that a reader of some movies opens their files only."""
    df.repartition("movie").write.mode("overwrite").partitionBy("movie").parquet(path)


def mark_done(units: DataFrame, path: str) -> None:
    """SNK6: ids of finished units, appended."""
    units.distinct().write.mode("append").parquet(path)


def done_units(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SNK6: ids of finished units; none yet where nothing was written."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).distinct()
