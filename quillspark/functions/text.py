"""Surface features and cleaning of review texts, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Notices that the shop puts into texts, in any case.
BOILERPLATE = (
    r"AN[AÁ]LISE DE ACESSO ANTECIPADO",
    r"produto recebido de gra[cç]a",
    r"produto reembolsado",
)
#: Texts are cut to so many characters for each use.
MAX_CHARS = {"scoring": 1200, "detection": 2000, "prompt": 1500, "sequence": 500, "judge": 300}
#: Fixed value: fewer letters than this aren't enough to tell a language.
MIN_LETTERS = 20

_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def n_chars(text: Column) -> Column:
    return F.length(text)


def n_words(text: Column) -> Column:
    """Pieces between white space of the trimmed text; 0 for null and blank."""
    bare = F.trim(text)
    return F.when(text.isNull() | (bare == ""), 0).otherwise(F.size(F.split(bare, r"\s+")))


def caps_ratio(text: Column) -> Column:
    """Upper-case share of ASCII letters, 0 without letters."""
    text = F.coalesce(text, F.lit(""))
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.when(letters == 0, 0.0).otherwise(F.length(F.regexp_replace(text, "[^A-Z]", "")) / letters)


def n_shouts(text: Column) -> Column:
    """Words of three or more capitals; word borders are ASCII."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?<![A-Za-z0-9_])[A-Z]{3,}(?![A-Za-z0-9_])"))


def n_r_runs(text: Column) -> Column:
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit("r{3,}"))


def n_marks(text: Column, mark: str) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def surface_features(text: Column) -> dict[str, Column]:
    return {
        "len_chars": n_chars(text),
        "len_words": n_words(text),
        "caps_ratio": caps_ratio(text),
        "upper_word_count": n_shouts(text),
        "rrun_count": n_r_runs(text),
        "excl_count": n_marks(text, "!"),
        "ques_count": n_marks(text, "?"),
    }


def without_boilerplate(text: Column, collapse: bool = False) -> Column:
    """The text without notices, trimmed; with collapse, runs of white space become one space."""
    for p in BOILERPLATE:
        text = F.regexp_replace(text, f"(?iu){p}", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " ")) if collapse else F.trim(text)


def _plain(text: Column) -> Column:
    """The text without addresses and notices. What each of these holds in any case is looked for first, as most texts
    have none and patterns are slow."""
    text = F.when(text.contains("http") | text.contains("www."), F.regexp_replace(text, r"http\S+|www\.\S+", " ")).otherwise(text)
    low = F.lower(text)
    return F.when(low.contains("antec") | low.contains("produto re"), F.regexp_replace(text, f"(?iu){'|'.join(BOILERPLATE)}", " ")).otherwise(text)


def for_detection(text: Column) -> Column:
    """Letters and single spaces of the first characters: no URLs, notices, digits or symbols; null is empty."""
    text = _plain(F.substring(F.coalesce(text, F.lit("")), 1, MAX_CHARS["detection"]))
    return F.trim(F.regexp_replace(text, r"[[^\p{L}\p{N}]0-9]+", " "))


def for_terms(text: Column) -> Column:
    """Lower-case a-z and single spaces, Latin accents folded; null is empty."""
    text = F.translate(_plain(F.lower(F.coalesce(text, F.lit("")))), _ACCENTED, _PLAIN)
    return F.trim(F.regexp_replace(text, "[^a-z]+", " "))


def cut(text: Column, use: str) -> Column:
    return F.substring(text, 1, MAX_CHARS[use])


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4) + 150


def contains_term(text: Column, term: str) -> Column:
    """Literal, in any case; null is false."""
    return F.coalesce(F.lower(text).contains(term.lower()), F.lit(False))


def matches(text: Column, pattern: str) -> Column:
    """A regular expression in any case; null is false."""
    return F.coalesce(text.rlike(f"(?iu){pattern}"), F.lit(False))


def has_tag(tags: Column, term: str) -> Column:
    return F.coalesce(F.exists(tags, lambda t: F.lower(t).contains(term.lower())), F.lit(False))


#: The wording of a request to judge a user's texts.
PROMPT_HEAD = "User's reviews (%d total):"
PROMPT_HEAD_SHOWN = "User's reviews (%d total, showing %d at random):"
PROMPT_TEXT = '[%d] """%s"""'
PROMPT_MORE = "... and %d more reviews not shown."


def prompt(texts: Column, total: Column, cap: int, ask: str) -> Column:
    """The numbered texts shown of a user's, with how many there are, those not shown, and what is asked."""
    whole = F.array(F.format_string(PROMPT_HEAD, total))
    part = F.array(F.format_string(PROMPT_HEAD_SHOWN, total, F.lit(cap)))
    shown = F.transform(texts, lambda t, i: F.format_string(PROMPT_TEXT, i, cut(t, "prompt")))
    end = F.array(F.lit(ask))
    missing = F.array(F.format_string(PROMPT_MORE, total - cap))
    return F.array_join(F.when(total > cap, F.concat(part, shown, missing, end)).otherwise(F.concat(whole, shown, end)), "\n")
