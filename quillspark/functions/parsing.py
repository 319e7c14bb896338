"""Cleaning raw columns: sentinels, casts, dates, prices, URLs, and lenient parsing of model output."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Months of dates such as "16 de maio de 2022".
MONTHS = {
    "janeiro": 1, "fevereiro": 2, "março": 3, "abril": 4, "maio": 5, "junho": 6,
    "julho": 7, "agosto": 8, "setembro": 9, "outubro": 10, "novembro": 11, "dezembro": 12,
}


def nullify_sentinels(df: DataFrame) -> DataFrame:
    """Empty text, "-1" and -1 become null in every column."""

    def clean(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind == "string":
            return F.when(~c.isin("", "-1"), c).alias(name)
        if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
            return F.when(c != -1, c).alias(name)
        return c

    return df.select(*(clean(n, k) for n, k in df.dtypes))


def cast_present(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Casts the columns that exist; what doesn't parse becomes null."""
    return df.withColumns({n: F.col(n).try_cast(t) for n, t in types.items() if n in df.columns})


def to_number(text: Column) -> Column:
    return text.try_cast("double")


def to_integer(text: Column) -> Column:
    """A number's integer part, parsed as a double first."""
    return F.floor(text.try_cast("double")).cast("long")


def price(text: Column) -> Column:
    """0 for "Free", else the number or null."""
    return F.when(text == "Free", 0.0).otherwise(text.try_cast("double"))


def recommended(code: Column) -> Column:
    """1 true, 0 false, anything else null."""
    return F.when(code == 1, True).when(code == 0, False)


def iso_date(text: Column, fmt: str = "yyyy-MM-dd") -> Column:
    return F.date_format(F.try_to_date(text, fmt), "yyyy-MM-dd")


#: Fixed value: how a date reads, anywhere in a lower-case text.
DAY_MONTH_YEAR = r"([0-9]{1,2}) de ([\p{L}\p{N}_]+) de ([0-9]{4})"


def portuguese_date(text: Column) -> Column:
    """The ISO date of the first "16 de maio de 2022" in a text, in any case; null if that is no date, as 31 February."""
    low = F.lower(text)
    day, name, year = (F.regexp_extract(low, DAY_MONTH_YEAR, i) for i in (1, 2, 3))
    month = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), name), F.lit(0))
    found = F.try_to_date(F.concat(year, F.lit("-"), month.cast("string"), F.lit("-"), day), "y-M-d")
    return F.date_format(found, "yyyy-MM-dd")


def profile_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"profiles/([0-9]+)", 1), F.lit(""))


def vanity_name(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/id/([^/]+)", 1), F.lit(""))


def group_key(url: Column) -> Column:
    """The profile's number, else v: and its name, else null."""
    return F.coalesce(profile_id(url), F.concat(F.lit("v:"), vanity_name(url)))


def url_type(url: Column) -> Column:
    low = F.lower(url)
    return F.when(low.like("%/profiles/%"), "profiles").when(low.like("%/id/%"), "vanity").otherwise("outro")


def split_tags(text: Column) -> Column:
    """Comma-separated values, trimmed, without empty ones; null stays null."""
    return F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")


def value_count(text: Column) -> Column:
    """How many comma-separated values a text has; 0 for null."""
    return F.coalesce(F.size(F.split(text, ",")), F.lit(0))


def bin_lower_bound(text: Column) -> Column:
    """The lower end of "... [0.9, 1.0)"; null if there's none."""
    return F.nullif(F.regexp_extract(text, r"\[\s*([0-9.]+)\s*,", 1), F.lit("")).try_cast("double")


def json_block(text: Column) -> Column:
    """A JSON object's text: the whole, if it is one, else its first {...} block, else {}."""
    whole = F.trim(text)
    block = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(whole.startswith("{") & whole.endswith("}"), whole).when(block != "", block).otherwise("{}")


def _said(text: Column, name: str) -> Column:
    """What an answer gives for a name, up to the next comma, brace, quote or space: from its JSON object, if it has
    one that parses, else from `name: value` anywhere; null if it doesn't name it."""
    parsed = F.get_json_object(json_block(text), f"$.{name}")
    loose = F.get(F.split(F.get(F.split(text, rf'(?i){name}"?\s*:\s*"?'), F.lit(1)), r'[\s,}"]'), F.lit(0))
    return F.lower(F.trim(F.coalesce(parsed, loose)))


def answer_label(text: Column) -> Column:
    """1 or 0 from an answer's "label", else from its words; null if neither says."""
    label, words = _said(text, "label"), F.lower(F.trim(text))
    return F.coalesce(
        F.when(label.rlike("^toxic"), 1).when(label.rlike("^non-?toxic"), 0),
        F.when(words.rlike('^toxic|"toxic"'), 1).when(words.rlike("^not|non-?toxic"), 0),
    )


def answer_score(text: Column, label: Column) -> Column:
    """The answer's score of 0 to 100 as 0 to 1, else its label, else 0."""
    percent = _said(text, "user_toxicity_score").try_cast("double")
    bounded = F.when(percent >= 0, F.least(percent, F.lit(100.0)) / 100)
    return F.coalesce(bounded, label.cast("double"), F.lit(0.0))


def answer_worst(text: Column) -> Column:
    """The index of the worst review, -1 if the answer has none."""
    return F.coalesce(_said(text, "worst_review").try_cast("int"), F.lit(-1))
