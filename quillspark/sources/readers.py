"""Readers for the layouts in which corpora come; all paths may be in any store that Spark reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _statuses(spark: SparkSession, path: str, recursive: bool = False) -> list:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out, todo = [], [where]
    while todo:
        for s in fs.listStatus(todo.pop()):
            out.append(s)
            if recursive and s.isDirectory():
                todo.append(s.getPath())
    return out


def list_parquet(spark: SparkSession, path: str, recursive: bool = False) -> tuple[list[str], list[str]]:
    """Sorted parquet files of a folder, and the sorted suffixes of its other files."""
    files = [s.getPath() for s in _statuses(spark, path, recursive) if not s.isDirectory()]
    names = [p.toString() for p in files if not p.getName().startswith(("_", "."))]
    found = sorted(n for n in names if n.endswith(".parquet"))
    others = sorted({n.rpartition("/")[2].rpartition(".")[2] for n in names if not n.endswith(".parquet")})
    return found, others


def parquet(spark: SparkSession, *paths: str, recursive: bool = False, merge: bool = False, schema: StructType | None = None) -> DataFrame:
    """Parquet files or folders; merge unites columns by name where files differ."""
    reader = spark.read.option("pathGlobFilter", "*.parquet") if recursive else spark.read
    reader = reader.option("recursiveFileLookup", str(recursive).lower()).option("mergeSchema", str(merge).lower())
    return (reader.schema(schema) if schema is not None else reader).parquet(*paths)


def with_row_ids(df: DataFrame) -> DataFrame:
    """A scan with each row's file name and place in the file."""
    return df.select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row_index"))


def json_array(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A JSON document that is an array of objects."""
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines, without malformed ones."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("header", "true")
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")).csv(path)


def annotations(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Annotation tables in CSV or parquet; an Excel sheet where pandas can read one."""
    if path.endswith((".xlsx", ".xls")):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet or 0))
    return spark.read.parquet(path) if path.endswith(".parquet") else csv(spark, path)


def language_layout(spark: SparkSession, root: str, language: str, column: str = "review_lang") -> DataFrame:
    """A language's rows from root/column=language, root/language, or a flat folder with the column."""
    names = {s.getPath().getName() for s in _statuses(spark, root) if s.isDirectory()}
    if f"{column}={language}" in names:
        return spark.read.option("basePath", root).parquet(f"{root}/{column}={language}")
    if language in names:
        return spark.read.parquet(f"{root}/{language}").withColumn(column, F.lit(language))
    return spark.read.parquet(root).where(F.col(column) == language)


def languages(spark: SparkSession, root: str, column: str = "review_lang") -> list[str]:
    """Languages of any of these layouts, sorted."""
    names = [s.getPath().getName() for s in _statuses(spark, root) if s.isDirectory()]
    named = [n.removeprefix(f"{column}=") for n in names if not n.startswith(("_", "."))]
    if named:
        return sorted(named)
    return sorted(r[0] for r in spark.read.parquet(root).select(column).distinct().collect())


def discover(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """Parquet files below root by what their columns say they are: users, games, reviews or other."""
    kinds: dict[str, list[str]] = {"users": [], "games": [], "reviews": [], "other": []}
    for f in list_parquet(spark, root, recursive=True)[0]:
        try:
            columns = set(spark.read.parquet(f).columns)
        except AnalysisException:
            columns = set()
        kind = "reviews" if {"review_url", "review_text"} <= columns else "users" if "steam_id" in columns else "games" if {"game_id", "popular_tags"} <= columns else "other"
        kinds[kind].append(f)
    return kinds


def register(spark: SparkSession, name: str, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a temporary view."""
    df = spark.createDataFrame(rows, schema)
    df.createOrReplaceTempView(name)
    return df
