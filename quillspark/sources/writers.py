"""Writers: atomic publication, resumable parts, reports and narratives."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def parquet(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """One table, overwritten. Never partitioned by a column that a rerun may change."""
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def publish(df: DataFrame, path: str) -> None:
    """Written aside and then renamed, so a reader sees the old table or the new one."""
    spark = df.sparkSession
    aside = f"{path}.tmp-{uuid.uuid4().hex}"
    df.write.parquet(aside)
    fs, new = _fs(spark, aside)
    _, old = _fs(spark, path)
    if fs.exists(old):
        fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{aside} can't be renamed")


def part_once(df: DataFrame, path: str, part: str) -> bool:
    """Writes a named part unless it is there already; whether it was written."""
    target = f"{path}/part_name={part}"
    if exists(df.sparkSession, f"{target}/_SUCCESS"):
        return False
    df.write.mode("overwrite").parquet(target)
    return True


def csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """A table as CSV files with headers, a task each; a small one as one file."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", "true").csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def metric_rows(df: DataFrame, path: str) -> None:
    """Metric rows, appended as a partition for each (label, arm, model)."""
    df.write.mode("append").partitionBy("label", "arm", "model").parquet(path)


def report(df: DataFrame, path: str) -> dict:
    """A one-row table as a JSON document, written through Spark's file system."""
    row = df.first().asDict(recursive=True)
    fs, where = _fs(df.sparkSession, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(json.dumps(row, indent=2, default=str, ensure_ascii=False).encode()))
    finally:
        out.close()
    return row


def markdown(df: DataFrame, title: str, body: str, limit: int = 200) -> str:
    """The first rows of a small table as Markdown sections."""
    return "\n\n".join(f"## {r[title]}\n\n{r[body]}" for r in df.orderBy(title).limit(limit).collect())


def vocabulary(vocab: DataFrame, n_docs: int, path: str) -> None:
    """A fitted vocabulary with the number of its documents, to be read again without a fit."""
    vocab.withColumn("n_docs", F.lit(n_docs)).write.mode("overwrite").parquet(path)


def findings(df: DataFrame, patterns: dict[str, str], blocked: tuple[str, ...]) -> DataFrame:
    """(column, rule, n): blocked column names, and text cells that match a sensitive pattern; an export is clean without rows."""
    strings = [n for n, t in df.dtypes if t == "string"]
    names = [n for n in df.columns if n.lower() in blocked]
    counts = df.agg(F.count("*").alias("_n"), *(F.count_if(F.coalesce(F.col(c).rlike(p), F.lit(False))).alias(f"{c}|{r}") for c in strings for r, p in patterns.items()))
    cells = [F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"), F.col(f"`{c}|{r}`").alias("n")) for c in strings for r in patterns]
    cells += [F.struct(F.lit(c).alias("column"), F.lit("blocked name").alias("rule"), F.col("_n").alias("n")) for c in names]
    return counts.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("n > 0")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
