"""Writers. All go through Spark's commit protocol; nothing is gathered to write one file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.functions.text import csv_cell
from cuelattice.operators.reports import keep_first, upsert


def bundle(vectors: DataFrame, path: str) -> None:
    """Embeddings by key as Parquet, a folder for each key."""
    vectors.write.mode("overwrite").partitionBy("embedding_key").parquet(path)


def csv(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def json_lines(df: DataFrame, path: str, append: bool = True) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def text_table(df: DataFrame, path: str, separator: str = "\t") -> None:
    """Rows as text lines, columns parted by ``separator``."""
    df.select(F.concat_ws(separator, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)).alias("value")).write.mode("overwrite").text(path)


def quoted_line(columns: list[tuple[Column, str]]) -> Column:
    """A CSV line: columns by kind 'text' (quoted), 'number' or 'bare' (as it is)."""
    cell = lambda c, kind: F.coalesce(c.cast("string"), F.lit("NA")) if kind == "bare" else csv_cell(c, kind == "number")
    return F.concat_ws(",", *(cell(c, kind) for c, kind in columns))


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path of any scheme."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def whole(spark: SparkSession, pattern: str) -> list[str]:
    """The folders of a pattern that a finished job wrote; only names are listed."""
    fs, marks = file_system(spark, f"{pattern}/_SUCCESS")
    return [s.getPath().getParent().toString() for s in (fs.globStatus(marks) or [])]


def delete(spark: SparkSession, path: str) -> None:
    fs, place = file_system(spark, path)
    fs.delete(place, True)


def metadata(summary: DataFrame, path: str) -> None:
    """A small table, such as one row of a run's figures, as JSON lines in one file."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def upsert_parquet(spark: SparkSession, new: DataFrame, path: str, keys: list[str], keep: int = 2) -> str:
    """Writes ``path`` merged with ``new`` (newest wins) to the path's next version and returns it.

    Versions lie side by side as path/v=N, so that readers of the old one are not disturbed and a failed run leaves it whole;
    the newest ``keep`` versions stay.
    """
    done = sorted(int(p.rsplit("=", 1)[-1]) for p in whole(spark, f"{path}/v=*"))
    latest = done[-1] if done else 0
    rows = upsert(spark.read.parquet(f"{path}/v={latest}"), new, keys) if latest else new
    rows.write.mode("overwrite").parquet(f"{path}/v={latest + 1}")
    for old in done[: max(0, len(done) + 1 - keep)]:
        delete(spark, f"{path}/v={old}")
    return f"{path}/v={latest + 1}"


def merge_shards(spark: SparkSession, paths: list[str], key: str, order: list[str]) -> DataFrame:
    """The rows of all shards, the first of each key, in order of the key."""
    rows = None
    for n, p in enumerate(paths):
        part = spark.read.parquet(p).withColumn("__shard", F.lit(n))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return keep_first(rows, [key], ["__shard", *order]).drop("__shard").orderBy(key)


def append_csv(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Adds rows to a folder whose files, one after another in the order of their names, are one CSV: the header stands in the first only.

    The header is written with the first rows; a run that fails before its end leaves none of its rows.
    """
    lines = df.select(F.to_csv(F.struct(*df.columns)).alias("value"))
    batches = len(whole(spark, f"{path}/batch=*"))
    if not batches:
        lines_of_names = spark.createDataFrame([(",".join(f'"{c}"' if set(c) & set(',"\n') else c for c in df.columns),)], "value string")
        lines_of_names.coalesce(1).write.mode("overwrite").text(f"{path}/batch=00000000")
        batches = 1
    lines.write.mode("overwrite").text(f"{path}/batch={batches:08}")
