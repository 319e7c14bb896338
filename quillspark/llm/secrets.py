"""Secret scans: candidates by shape, false positives removed by a random forest, in DataFrame functions."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._common import staged

#: Tokens lie between these; a candidate is a token of printable ASCII with a digit and a letter, of LEAST characters or
#: more, or LEAST_ASSIGNED after a name.
BETWEEN = r"""[\s"'`,;()<>{}\[\]|]+"""
CANDIDATE = r"^(?=.*[A-Za-z])(?=.*[0-9])[\x21-\x7e]+$"
LEAST, LEAST_ASSIGNED = 12, 8
#: A name and the value joined to it: the password of an address's user, a key in an address's query, name:value, name=value.
ASSIGNED = (
    r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/@:]*:)(.+)@[^@]*$",
    r"(?i)^([a-z]+://.*[?&][a-z0-9_\-]*(?:key|token|secret|auth|passw|pwd|sig)[a-z0-9_\-]*=)([^&#]+).*$",
    r"^(-{0,2}[A-Za-z_][A-Za-z0-9_.\-]*[:=]+)(?!//)(.+)$",
)
NEIGHBOURS = 3
#: Words by a secret, and words by what only looks like one.
SECRET_WORDS = ("token", "key", "apikey", "api_key", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential", "credentials", "access_key", "private", "client_secret")
INNOCENT_WORDS = ("commit", "sha", "sha1", "sha256", "md5", "hash", "checksum", "digest", "uuid", "guid", "version", "build", "revision", "id", "file", "path", "url", "see")
#: Parts of placeholders and of paths that hold no live secrets.
PLACEHOLDER = r"(?i)x{6,}|0{8,}|1234567|abcdef|example|sample|dummy|changeme|placeholder|your[_-]|redacted|\*{4,}"
QUIET_PATH = r"(?i)(^|[/_.-])(tests?|fixtures?|examples?|samples?|docs?|mocks?)([/_.-]|$)"
#: A basic dictionary; words that the corpus uses on their own are added.
DICTIONARY = (
    "about account action address admin agent alpha application archive async attribute backup base batch beta block branch buffer build cache call change char class clean cloud cluster color column commit common config connect content context copy core create current data database debug default demo deploy detail device display document download driver email empty engine error example export feature field filter final first float form format function game global graph handle header help hidden host html image import info init install integer item java json label last layer length level light line linux list local lock main manager match media memory message method mobile model module name network note null object open order output page panel part path picture plugin port print process profile property public query queue read record report request resource response return root sample save schema script select server session share size socket space start static status store stream style submit table target template test theme thread title type upload user value version view web width window work write"
).split()
#: The most frequent pairs of letters of English.
PAIRS = "th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur ic co me ro ri li ma ne ce io om".split()
FEATURES = ("length", "transitions", "bigrams", "digits", "uppers", "distinct", "hex_only", "coverage", "placeholder", "separators", "path_like", "quiet_path", "assigned", "secret_words", "innocent_words")

#: The forest, and a bound on the labelled findings that it's fitted on.
TREES, DEPTH, SEED, MOST_FINDINGS = 40, 8, 17, 20_000
BROADCAST_ROWS = 1_000_000


def candidates(docs: DataFrame, *, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    """(id, position, token, path, before, after): each token of a candidate's shape, its place among
    the text's tokens, and up to NEIGHBOURS tokens on either side, lower-cased."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    texts = docs.select(F.col(id_col).alias("id"), path.alias("path"), F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), BETWEEN), "").alias("tokens"))
    at = texts.where(F.size("tokens") > 0).select("id", "path", "tokens", F.explode(F.sequence(F.lit(0), F.size("tokens") - 1)).alias("position"))
    token = F.get("tokens", F.col("position"))
    # A sentence's last character isn't the token's.
    bare = F.regexp_replace(token, r"^[.:=]+|[.:!?#*$%&=]+$", "")
    part = lambda i: F.coalesce(*(F.nullif(F.regexp_extract("bare", p, i), F.lit("")) for p in ASSIGNED))
    shaped = at.where((F.length(token) >= LEAST_ASSIGNED) & token.rlike("[0-9]")).withColumn("bare", bare)
    shaped = shaped.withColumns({"name": F.coalesce(part(1), F.lit("")), "token": F.coalesce(part(2), "bare")})
    assigned = (F.col("name") != "") | F.coalesce(F.get("tokens", F.col("position") - 1), F.lit("")).rlike("[=:]$")
    shaped = shaped.where((F.length("token") >= F.when(assigned, LEAST_ASSIGNED).otherwise(LEAST)) & F.col("token").rlike(CANDIDATE))
    near = lambda lo, n: F.array_remove(F.split(F.lower(F.array_join(F.slice("tokens", lo, n), " ")), " "), "")
    lo = F.greatest(F.lit(1), F.col("position") + 1 - NEIGHBOURS)
    before = F.array_remove(F.array_append(near(lo, F.col("position") + 1 - lo), F.lower("name")), "")
    return shaped.select("id", F.col("position").cast("long").alias("position"), "token", "path", before.alias("before"), near(F.col("position") + 2, F.lit(NEIGHBOURS)).alias("after"))


def _parts(tokens: DataFrame) -> DataFrame:
    return tokens.select("token", F.explode(F.regexp_extract_all(F.lower("token"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))


def corpus_words(docs: DataFrame, tokens: DataFrame, *, text_col: str, least: int = 3) -> DataFrame:
    """(word) of the candidates' alphabetic parts that the corpus uses on their own `least` times or more.

    Words are counted before they meet the parts: a part may be one of the corpus's most frequent words.
    """
    parts = staged(_parts(tokens).select("word").distinct(), "parts")
    parts = F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts
    used = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}_\-+/=.@]+|[.]+(\s|$)")).alias("word"))
    often = used.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return often.join(parts, "word").select("word")


def coverage(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(token, coverage): the share of a token's characters in parts that are in the dictionary words(word)."""
    fixed = tokens.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, DICTIONARY))).alias("word"))
    known = words.union(fixed).distinct()
    found = _parts(tokens).join(known, "word", "left_semi").groupBy("token").agg(F.sum(F.length("word")).alias("n"))
    return tokens.join(found, "token", "left").select("token", (F.coalesce("n", F.lit(0)) / F.length("token")).alias("coverage"))


def featured(found: DataFrame, covered: DataFrame) -> DataFrame:
    """found with the FEATURES as doubles; covered(token, coverage) has a row for each token."""
    token, n = F.col("token"), F.length("token").cast("double")
    count = lambda p: F.regexp_count(token, F.lit(p)).cast("double")
    plain = lambda w: F.regexp_replace(F.regexp_extract(w, "([^:/?&]*)[^a-z0-9_]*$", 1), "[^a-z0-9_]", "")
    has = lambda words, where: F.size(F.filter(where, lambda w: plain(w).isin(*words))).cast("double")
    both = F.concat("before", "after")
    last = F.coalesce(F.try_element_at(F.filter("before", lambda w: w != ""), F.lit(-1)), F.lit(""))
    values = {
        "length": n,
        "transitions": count(r"[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])") / n,
        "bigrams": count(f"(?i)(?={'|'.join(PAIRS)})") / n,
        "digits": count("[0-9]") / n,
        "uppers": count("[A-Z]") / n,
        "distinct": F.size(F.array_distinct(F.split(token, ""))) / n,
        "hex_only": token.rlike("^[0-9a-fA-F]+$").cast("double"),
        "placeholder": token.rlike(PLACEHOLDER).cast("double"),
        "separators": count(r"[._\-/]") / n,
        "path_like": token.rlike(r"/.+/|\.[a-z]{2,4}(/|$)|^https?:").cast("double"),
        "quiet_path": F.col("path").rlike(QUIET_PATH).cast("double"),
        "assigned": last.rlike(r"[=:]$").cast("double"),
        "secret_words": has(SECRET_WORDS, "before"),
        "innocent_words": has(INNOCENT_WORDS, both),
    }
    out = found.join(covered, "token")
    return out.withColumns(values)


def labelled_findings(spark: SparkSession, n: int = 4_000, seed: str = "findings") -> DataFrame:
    """(id, text, path, label): findings made by rule, half of them live secrets.

    Secrets are assigned keys in hex, base64 and mixed case, keys of well-known formats, passwords with signs,
    passwords of addresses' users and addresses that are keys themselves. The others are what scans confuse with
    them: digests, UUIDs, paths, addresses of pages and mail, times, identifiers, settings, placeholders.
    """
    if n > MOST_FINDINGS:
        raise ValueError(f"at most {MOST_FINDINGS} findings")
    draw = lambda tag: F.md5(F.concat(F.lit(f"{seed}:{tag}:"), F.col("id").cast("string")).cast("binary"))
    number = lambda tag, m: F.pmod(F.conv(F.substring(draw(tag), 1, 12), 16, 10).cast("long"), F.lit(m))
    pick = lambda tag, words: F.element_at(F.array(*map(F.lit, words)), (number(tag, len(words)) + 1).cast("int"))
    word = lambda tag: pick(tag, DICTIONARY)
    hexes = F.concat(draw("h1"), draw("h2"))
    b64 = F.regexp_replace(F.base64(F.unhex(hexes)), "=", "")
    cut = lambda c, lo, spread: F.substring(c, F.lit(1), (F.lit(lo) + number("cut", spread)).cast("int"))
    named = lambda: F.concat(pick("name", SECRET_WORDS), pick("sign", (" = \"", ": \"", "=\"", " ", " = ", ": ", ":", "=")))
    password = F.concat(F.initcap(word("w1")), pick("sign1", ("@", "!", "#", "$", "%", "^", "&", "*")), F.substring(b64, 1, 4), number("v", 9999), F.upper(F.substring(hexes, 9, 2)))
    pages = F.concat(pick("scheme", ("https://", "http://")), word("p1"), pick("top", (".com", ".org", ".io")))
    secrets = [
        F.concat(named(), cut(hexes, 32, 33)),
        F.concat(named(), cut(b64, 20, 23)),
        F.concat(named(), F.lit("AKIA"), F.upper(F.substring(F.regexp_replace(b64, "[+/]", "7"), 1, 16))),
        F.concat(named(), F.lit("ghp_"), F.substring(F.regexp_replace(b64, "[+/]", "Q4"), 1, 36)),
        F.concat(named(), F.lit("sk_live_"), F.substring(F.regexp_replace(b64, "[+/]", "z9"), 1, 24)),
        F.concat(named(), hexes.substr(1, 40)),
        F.concat(named(), password),
        F.concat(pick("scheme", ("postgres", "mysql", "redis", "amqp", "https", "ftp")), F.lit("://"), word("u"), F.lit(":"), pick("pass", ("", "x9", "Q7")), F.substring(b64, 1, 12), number("v", 99), F.lit("@"), word("h"), F.lit(".local:5432/"), word("p2")),
        F.concat(pages, F.lit("/services/T"), F.upper(F.substring(hexes, 1, 8)), F.lit("/B"), F.upper(F.substring(hexes, 9, 8)), F.lit("/"), F.substring(F.regexp_replace(b64, "[+/]", "m3"), 1, 24)),
        F.concat(pages, F.lit("/"), word("p2"), F.lit("?"), pick("query", ("api_key=", "token=", "sig=", "auth=")), cut(F.regexp_replace(b64, "[+/]", "r5"), 20, 20)),
    ]
    harmless = [
        F.concat(pick("say", INNOCENT_WORDS), F.lit(" "), cut(hexes, 32, 33)),
        F.concat(pick("say", INNOCENT_WORDS), F.lit(" "), F.concat_ws("-", hexes.substr(1, 8), hexes.substr(9, 4), hexes.substr(13, 4), hexes.substr(17, 4), hexes.substr(21, 12))),
        F.concat(F.lit("/"), word("p1"), F.lit("/"), word("p2"), F.lit("/"), word("p3"), F.lit("_"), number("v", 99), F.lit(".py")),
        F.concat(word("p1"), F.lit("."), word("p2"), number("v", 99), F.lit(".example.com")),
        F.concat(word("p1"), F.lit("_"), word("p2"), F.lit("_"), word("p3"), number("v", 999)),
        F.concat(F.initcap(word("p1")), F.initcap(word("p2")), F.initcap(word("p3")), number("v", 99)),
        F.concat(named(), pick("fake", ("YOUR_API_KEY_HERE_1", "xxxxxxxxxxxxxxxx1234", "example_token_1234567", "changeme123456", "dummy-secret-000000001"))),
        F.concat(word("p1"), F.lit("-"), word("p2"), F.lit("-"), number("v", 20), F.lit("."), number("w", 20), F.lit(".jar")),
        F.concat(pages, F.lit("/"), word("p2"), F.lit("/"), word("p3"), F.lit("-"), word("w"), F.lit("-"), number("v", 9999)),
        F.concat(pages, F.lit("/"), word("p2"), F.lit("?page="), number("v", 99), F.lit("&sort="), word("w")),
        F.concat(word("p1"), F.lit("."), word("p2"), number("v", 99), F.lit("@"), word("p3"), F.lit(".org")),
        F.concat(pick("when", ("at", "date", "since", "time:", "updated=")), F.lit(" 20"), number("v", 30) + 10, F.lit("-0"), number("w", 9) + 1, F.lit("-1"), number("z", 9), F.lit("T1"), number("y", 9), F.lit(":30:0"), number("x", 9), F.lit("Z")),
        F.concat(pick("set", ("mode", "name", "host", "image", "target", "level", "profile")), pick("sign", (" = ", ": ", ":", "=")), word("p2"), pick("sign2", ("-", "_", ":", "/")), word("p3"), number("v", 999)),
    ]
    choose = lambda kinds, tag: reduce(lambda rest, i: F.when(number(tag, len(kinds)) == i, kinds[i]).otherwise(rest), range(1, len(kinds)), kinds[0])
    label = (F.col("id") % 2).cast("double")
    body = F.when(label > 0, choose(secrets, "s")).otherwise(choose(harmless, "n"))
    path = F.concat_ws("/", pick("d", ("src", "lib", "config", "deploy", "tests", "docs")), word("f"))
    text = F.concat(word("a"), F.lit(" "), word("b"), F.lit(" "), body, F.lit("\" "), word("c"))
    return spark.range(n).select("id", text.alias("text"), path.alias("path"), label.alias("label"))


def fit_forest(findings: DataFrame, *, text_col: str = "text", path_col: str = "path") -> PipelineModel:
    """A random forest on labelled findings(id, text, path, label), each with one candidate or more."""
    found = candidates(findings, id_col="id", text_col=text_col, path_col=path_col).join(findings.select("id", "label"), "id")
    found = staged(found, "findings")
    tokens = found.select("token").distinct()
    rows = featured(found, coverage(tokens, tokens.select(F.col("token").alias("word")).where(F.lit(False)))).orderBy("id", "position").coalesce(1)
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(rows)


def scan_secrets(docs: DataFrame, model: PipelineModel | None = None, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """A row for each candidate: id, position, secret, features, probability, is_secret.

    Candidates are tokens between white space, quotes and brackets of 12 characters or more with a letter and
    a digit, of printable ASCII; of name:value and name=value, of a key in an address's query and of an address with a
    user's password the value alone, the name being a neighbour. After a name or sign 8 characters are enough. Their
    features are length, changes between character classes, frequent pairs of letters, shares of classes, the
    share covered by dictionary words (the fixed list and words that the whole corpus uses on their
    own), signs of a path, the document's path and the neighbouring words. The forest (by default
    fitted on labelled_findings()) gives the probability of a live secret; is_secret is true from
    `threshold` on. Coverage is computed once for each different token.

    Null and empty texts have no candidates; a null path is empty. Repeated rows give repeated
    candidates, and candidates of any length are read whole. Other columns are not read.
    """
    model = model or fit_forest(labelled_findings(docs.sparkSession))
    found = staged(candidates(docs, id_col=id_col, text_col=text_col, path_col=path_col), "candidates")
    tokens = staged(found.select("token").distinct(), "tokens")
    covered = staged(coverage(tokens, corpus_words(docs, tokens, text_col=text_col)), "coverage")
    scored = model.transform(featured(found, covered))
    chance = F.round(F.get(vector_to_array("probability"), F.lit(1)), 6)
    names: list[Column] = [F.col(f) for f in FEATURES]
    return scored.select("id", "position", F.col("token").alias("secret"), F.struct(*names).alias("features"), chance.alias("probability"), (chance >= threshold).alias("is_secret"))
