"""One query for each operator over the whole documents table, and SQL where it can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontamination, importance, language, licenses, mixing, phrases, quality, secrets, sharding, simhash, substrings, suffixes, topk
from quillspark.llm._common import documents
from quillspark.llm.oracles import ORACLE_SQL as ORACLE_SQL


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weigh 3, 1, 2, ... and share 150 % of all words; no document is taken over twice."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    mix = mixing.mix_sources(docs, weights=(3.0, 1.0, 2.0), budget=1.5, most_repeats=2, keep_text=False)
    rows = [(s["source"], int(s["size"]), float(s["target"])) for s in mix.sources]
    sources = spark.createDataFrame(rows, "of string, source_size long, target double")
    sources = F.broadcast(sources) if len(rows) <= 10_000 else sources
    out = mix.docs.join(sources, F.col("source").eqNullSafe(F.col("of")), "left")
    return out.select("doc_id", F.col("size").cast("long").alias("size"), "source_size", "target", F.col("taken").cast("long").alias("taken"), "source")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, links at two differing bits or fewer."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    groups = simhash.near_duplicate_groups(docs, shingle_words=3, radius=2)
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all rules under the current policy."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = quality.ledger(docs)
    failed = F.col("failures").bitwiseAND(F.lit(quality.mask(quality.BASE))) != 0
    kept = quality.verdict(F.col("failures"), quality.POLICIES[quality.CURRENT])
    named = [F.col(f"measures.{m}").alias(m) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return found.select("doc_id", *named, failed.alias("base_failed"), (~failed & kept).alias("kept"), "failures")


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of near equal bytes by a k-d tree over text size and script, id, source and language."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source", "lang")
    marked, dims = sharding.with_metadata(docs)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = marked.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *dims)
    sharded = sharding.kd_shards(rows, size=F.col("size"), tie=F.xxhash64("doc_id", "text_crc32"), dimensions=[F.col(d) for d in dims], shards=16, drop=dims)
    slotted = sharding.with_slots(sharded, order=[F.col("doc_id"), F.col("text_crc32")], rows=docs.count())
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every document that repeat in the corpus, and what remains without later occurrences."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = substrings.dedup_substrings(docs, keep_bytes=False)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", (F.col("n_repeated") > 0).alias("has_repeats"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with the forest's verdict; the secret itself as its SHA-256."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    found = secrets.scan_secrets(docs)
    return found.select(F.col("id").alias("doc_id"), "position", F.sha2("secret", 256).alias("secret_sha256"), F.length("secret").cast("long").alias("length"), "probability", "is_secret")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in documents, a row for each document and item."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = decontamination.find_leaks(docs, benchmark)
    return leaks.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "similarity", "first_word", "last_word", "n_windows")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on the documents that aren't held out, applied to all."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    model = language.train(docs.where(~held_out))
    return language.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and template spans of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return licenses.scan_licenses(docs).withColumnRenamed("id", "doc_id").drop("spans")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte that 400-byte strings cover which start twice or more in the corpus goes; n_repeated counts those of
    256-byte strings, so that passages too short to go are reported."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = suffixes.remove_repeats(docs, keep_bytes=False)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", (F.col("n_repeated") > 0).alias("has_repeats"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 best phrases of two to five words found a hundred times or more."""
    docs = documents(spark, sf_dir).select("text", "lang")
    return phrases.collocations(docs, depth=5, least=100, best=2000)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five of a hundred documents, drawn by how much more likely their n-grams are in the benchmark's texts."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = importance.resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"), percent=5, least_words=20, seed=42)
    return out.select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def op13_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors by inner product for every hundredth id."""
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), k=10, scale=1024.0)


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_simhash": op2_simhash,
    "op3_quality_rules": op3_quality_rules,
    "op4_kd_shards": op4_kd_shards,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_decontaminate": op7_decontaminate,
    "op8_language_id": op8_language_id,
    "op9_license_scan": op9_license_scan,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_collocations": op11_collocations,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_exact_search": op13_exact_search,
}
