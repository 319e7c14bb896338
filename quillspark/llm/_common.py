"""What the operators share: tables written to the cluster's shared folder, and word counting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; on a local master without it, a temporary one."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="quillspark-")
    return _own_dirs[app]


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read again.

    This cuts the lineage: a lost executor costs a re-read. The folder goes when the application
    ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While it lasts, Python workers get Arrow batches of so few rows; for work that is staged inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_grams(texts: DataFrame, k: int, keys: Sequence[str], stretch: int = 64) -> DataFrame:
    """(keys, pos, h, part, at) for every k words in a row of texts(keys, words): their place and hash.

    A text is cut into stretches of so many starts first, so that a row holds a stretch's words (part, in which
    the words are at `at`), never a text's.
    """
    rows = texts.where(F.size("words") >= k)
    cut = F.transform(F.sequence(F.lit(0), F.size("words") - k, F.lit(stretch)), lambda i: F.struct(i.alias("base"), F.slice("words", i + 1, F.lit(stretch + k - 1)).alias("part")))
    parts = rows.select(*keys, F.explode(cut).alias("s")).select(*keys, "s.base", "s.part")
    places = parts.select(*keys, "base", "part", F.explode(F.sequence(F.lit(0), F.size("part") - k)).alias("at"))
    return places.select(*keys, (F.col("base") + F.col("at")).alias("pos"), F.xxhash64(*(F.get("part", F.col("at") + j) for j in range(k))).alias("h"), "part", "at")


def own_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
