"""The corpus pipeline over the documents table: quality rules, near-dedup, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. An empty table
passes through as an empty table. Extra columns stay, whatever their names, but for size, shard and
slot, which the last stage sets. Quality rules and decontamination judge rows one by one, so
repeated rows share their fate, and rows with a null id are judged like others; null and empty texts
fail the quality rules, and hold no benchmark item. Near-dedup keeps one row of each group: that of
the least id (nulls last), then of the least xxhash64 of its text; repeated rows are copies, and
null and empty texts are one group. The mix takes rows equal in id alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._common import documents, staged
from quillspark.llm.decontamination import drop_contaminated
from quillspark.llm.mixing import take_mix
from quillspark.llm.quality import keep_quality
from quillspark.llm.sharding import kd_shards, with_metadata, with_slots
from quillspark.llm.similar import drop_similar

SHARDS = 16


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current quality policy rejects go."""
    return keep_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays: that of the smallest id."""
    return drop_similar(docs, shingle_words=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 3, 1, 2, ... and share 150 % of all words; a document stays as often as the mix takes it."""
    return take_mix(docs, weights=(3.0, 1.0, 2.0), budget=1.5, most_repeats=2)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard of near equal bytes and their slot in it; repeated rows share a shard."""
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    digest = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    marked, dims = with_metadata(docs)
    sharded = kd_shards(marked, size=size, tie=F.xxhash64("doc_id", digest), dimensions=[F.col(d) for d in dims], shards=SHARDS, drop=dims)
    return with_slots(sharded, order=[F.col("doc_id"), F.xxhash64("text")], rows=docs.count())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: SimHash and the k-d tree have no SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
