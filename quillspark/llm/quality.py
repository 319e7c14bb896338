"""Quality rules as a ledger of failure bits, with versioned policies over it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillspark.llm._common import own_name

MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bars")

_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASUREMENTS of one text; null has zeros.

    Words are runs of characters other than ASCII white space. n_lines counts lines with a word and
    n_dup_lines those of them equal to an earlier one; n_repeat_words counts the words that lie in a
    three-word window found at least twice. n_upper and n_letters count ASCII letters, n_bars the words "|", which
    part the cells of tables.
    """
    if not text:
        return (0,) * len(MEASUREMENTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    bare = raw.translate(None, _SPACES)
    n_upper = len(raw) - len(raw.translate(None, _UPPER))
    return (
        len(words),
        len(bare) - (len(raw) - len(text)),  # bytes less continuation bytes: code points
        len(bare) - len(bare.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated_words(words),
        len(lines),
        n_upper,
        n_upper + len(raw) - len(raw.translate(None, _LOWER)),
        words.count(b"|"),
    )


def _repeated_words(words: list[bytes]) -> int:
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


_MEASURED = StructType([StructField(m, LongType(), False) for m in MEASUREMENTS])


def measured(text: Column) -> Column:
    """The MEASUREMENTS of a text column as a struct."""

    @F.pandas_udf(_MEASURED)
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            yield pd.DataFrame([measure(t) for t in s], columns=list(MEASUREMENTS), dtype="int64")

    return of(text)


#: Rules by bit: a name and the SQL that is true where a document fails. Bits are never reused.
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words + 10 * n_bars"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines AND n_dup_lines > 3"),
    ("shouting", "2 * n_upper > n_letters AND 2 * n_letters > word_chars"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
)
BASE = ("too_few_words", "repeated_windows")


def mask(names: tuple[str, ...]) -> int:
    at = {name: i for i, (name, _) in enumerate(RULES)}
    return sum(1 << at[n] for n in set(names))


@dataclass(frozen=True)
class Policy:
    """A version of what rejects a document: any of `reject`, or over `most` of the rules in `tally`."""

    version: str
    reject: tuple[str, ...]
    tally: tuple[str, ...] = field(default=())
    most: int = 0


POLICIES = {
    p.version: p
    for p in (
        Policy("v1", BASE),
        Policy("v2", (*BASE, "symbols", "repeated_lines", "shouting", "short_words", "long_words")),
        Policy("v3", BASE, ("symbols", "repeated_lines", "shouting", "short_words", "long_words"), 1),
    )
}
CURRENT = "v2"


def ledger(docs: DataFrame, *, text_col: str = "text", measures: str = "measures", failures: str = "failures") -> DataFrame:
    """docs with two more columns: the measurements (struct) and a long with a bit for each failed rule.

    Every rule is evaluated once. Null and empty texts have zero measurements, which fail
    too_few_words only. Columns of the same names are replaced; rows are neither merged nor split.
    """
    held = own_name(docs, "measures")
    out = docs.withColumn(held, measured(F.col(text_col)))
    bits = [F.when(F.expr(_over(sql, held)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, sql) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    rest = [c for c in docs.columns if c not in (measures, failures)]
    return out.select(*rest, F.col(held).alias(measures), total.alias(failures))


def _over(sql: str, held: str) -> str:
    return " ".join(f"{held}.{w}" if w in MEASUREMENTS else w for w in sql.split())


def verdict(failures: Column, policy: Policy) -> Column:
    """True where the policy keeps a document."""
    kept = failures.bitwiseAND(F.lit(mask(policy.reject))) == 0
    return kept & (F.bit_count(failures.bitwiseAND(F.lit(mask(policy.tally)))) <= policy.most) if policy.tally else kept


def ablations(found: DataFrame, policies: tuple[Policy, ...], *, failures: str = "failures") -> DataFrame:
    """(version, rule, n_failed, n_rejected_alone) for each rule that a policy rejects by.

    n_failed counts the documents that fail the rule, n_rejected_alone those that only this rule
    rejects, which would be kept without it. Documents are first counted by their failure bits, of
    which there are few, so policies of any number take one pass.
    """
    counts = found.groupBy(failures).agg(F.count("*").alias("n"))
    rows = [F.struct(F.lit(p.version).alias("version"), F.lit(r).alias("rule"), F.lit(mask(p.reject)).cast("long").alias("m"), F.lit(mask((r,))).cast("long").alias("bit")) for p in policies for r in p.reject]
    each = counts.select(failures, "n", F.explode(F.array(*rows)).alias("r")).select(F.col(failures).alias("f"), "n", "r.*")
    fails = F.col("f").bitwiseAND(F.col("bit")) != 0
    alone = F.col("f").bitwiseAND(F.col("m")) == F.col("bit")
    return each.groupBy("version", "rule").agg(F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_rejected_alone"))


def keep_quality(docs: DataFrame, *, text_col: str = "text", version: str = CURRENT) -> DataFrame:
    """The rows of docs that the policy keeps, with docs' columns only."""
    held, bits = own_name(docs, "measures"), own_name(docs, "failures")
    out = ledger(docs, text_col=text_col, measures=held, failures=bits)
    return out.where(verdict(F.col(bits), POLICIES[version])).select(*docs.columns)
