"""The driver's tables in the roles of a review corpus, for Spark and, as SQL, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import bootstrap

#: Reviews are line items: scores are rescaled, with missing and invalid ones, and keys repeat.
REVIEW_COLUMNS = (
    "concat(l_orderkey, '-', l_linenumber) AS review_url",
    "l_partkey AS game_id",
    "l_suppkey AS user_id",
    "CASE l_returnflag WHEN 'A' THEN 'en' WHEN 'N' THEN 'fr' ELSE 'und' END AS review_lang",
    "CASE l_linestatus WHEN 'F' THEN 'en' ELSE 'fr' END AS declared",
    "CASE WHEN l_quantity < 10 THEN false WHEN l_quantity <= 45 THEN true END AS is_recommended",
    "CAST(l_shipdate AS DATE) AS review_date",
    "l_extendedprice AS hours_played",
    "CASE WHEN l_quantity = 1 THEN NULL WHEN l_quantity = 2 THEN 1.2 ELSE round(l_discount * 10, 6) END AS perspective",
    "CASE WHEN l_quantity = 3 THEN -1.0 WHEN l_quantity = 4 THEN NULL ELSE round(l_tax * 12.5, 6) END AS detoxify",
)
#: Profiles are customers; some are without level, library or ban state.
PROFILE_COLUMNS = (
    "c_custkey AS user_id",
    "nullif(c_nationkey, 0) AS profile_level",
    "CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS library_size",
    "CASE c_mktsegment WHEN 'BUILDING' THEN true WHEN 'MACHINERY' THEN NULL ELSE false END AS has_ban",
    "CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_mktsegment END AS country",
)

R = f"r AS (SELECT {', '.join(REVIEW_COLUMNS)} FROM lineitem)"
P = f"p AS (SELECT {', '.join(PROFILE_COLUMNS)} FROM customer)"
G = "g AS (SELECT p_partkey AS game_id, p_brand AS title, string_split(p_name, ' ') AS tags FROM part)"
#: The validity mask and the union label of r.
VALID = "(coalesce(perspective BETWEEN 0 AND 1, false) AND coalesce(detoxify BETWEEN 0 AND 1, false))"
TOXIC = "(CASE WHEN perspective >= 0.7 OR detoxify >= 0.9 THEN 1 ELSE 0 END)"
#: A 60-bit number from a key's md5, by column.
MD5 = "('0x' || substr(md5({0}), 1, 15))::BIGINT"
#: Labelled documents.
D = "d AS (SELECT doc_id, text, lang, source, toxic FROM documents JOIN labels USING (doc_id))"
CLEAN = r"trim(regexp_replace(regexp_replace(strip_accents(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), 'http\S+|www\.\S+', ' ', 'g'), '(?i)AN[AÁ]LISE DE ACESSO ANTECIPADO', ' ', 'g'), '(?i)produto recebido de gra[cç]a', ' ', 'g'), '(?i)produto reembolsado', ' ', 'g')), '[^a-z\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def bootstrap_sql(rows: str, rounds: int, seed: int, each: bool = False) -> str:
    """Average precisions of a and b in Poisson resamples of rows(k, y, a, b): each round's, or their difference with its interval."""
    whole = "18446744073709551616::UHUGEINT"
    mix = lambda x, shift, by: f"((xor({x}, {x} >> {shift})::UHUGEINT * {by}::UHUGEINT) % {whole})::UBIGINT"
    weight = " + ".join(f"(u >= {t})::BIGINT" for t in bootstrap.POISSON)
    curve = lambda s: f"SELECT r, sum(pos / nullif(n_pos, 0) * tp / greatest(n, 1)) AS ap FROM (SELECT r, pos, sum(pos) OVER (PARTITION BY r) AS n_pos, sum(pos) OVER w AS tp, sum(all_) OVER w AS n FROM (SELECT r, {s} AS s, sum(w * y) AS pos, sum(w) AS all_ FROM w GROUP BY 1, 2) WINDOW w AS (PARTITION BY r ORDER BY s DESC)) GROUP BY 1"
    head = f"""
WITH rows_ AS ({rows}),
x0 AS (SELECT *, (({MD5.format(f"k::VARCHAR || '{seed}'")}::UHUGEINT + (r + 1)::UHUGEINT * {bootstrap.STEP}::UHUGEINT) % {whole})::UBIGINT AS x FROM rows_ CROSS JOIN range({rounds}) t(r)),
x1 AS (SELECT * REPLACE ({mix("x", 30, bootstrap.FIRST)} AS x) FROM x0),
x2 AS (SELECT * REPLACE ({mix("x", 27, bootstrap.SECOND)} AS x) FROM x1),
x3 AS (SELECT r, y, a, b, xor(x, x >> 31) >> 32 AS u FROM x2),
w AS (SELECT r, y, a, b, ({weight}) AS w FROM x3 UNION ALL SELECT -1, y, a, b, 1 FROM rows_),
p AS (SELECT r, p.ap AS ap_a, q.ap AS ap_b FROM ({curve("a")}) p JOIN ({curve("b")}) q USING (r) JOIN (SELECT r FROM w GROUP BY 1 HAVING sum(w * y) BETWEEN 1 AND sum(w) - 1) USING (r))
"""
    if each:
        return head + "SELECT r::INT AS round, round(ap_a, 6) AS ap_a, round(ap_b, 6) AS ap_b FROM p WHERE r >= 0"
    return head + """, q AS (SELECT quantile_cont(ap_b - ap_a, [0.025, 0.975]) FILTER (WHERE r >= 0) AS q, max(ap_b - ap_a) FILTER (WHERE r < 0) AS delta FROM p)
SELECT round(delta, 6) AS delta, round(q[1], 6) AS low, round(q[2], 6) AS high, q[1] > 0 OR q[2] < 0 AS excludes_0 FROM q"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*REVIEW_COLUMNS)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*PROFILE_COLUMNS)


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("game_id"), F.col("p_brand").alias("title"), F.split("p_name", " ").alias("tags"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
