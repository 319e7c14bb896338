"""Language identification by string kernels with Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The blended spectrum: n-grams of bytes of these lengths, presence only.
SPECTRUM = (1, 2, 3, 4)
#: Features are all n-grams found in the landmarks; an n-gram is known by TABLE_BITS bits of its hash, or by so many fewer
#: that features times languages, the model's size, are at most MOST_WEIGHTS numbers of 4 bytes.
TABLE_BITS, MOST_WEIGHTS = 22, 1 << 26
#: Bounds on what the classifier is fitted on: labelled documents of each language and in all, characters of each (longer
#: ones are cut there for the fit), and languages (those of most documents); landmarks of each language and in all (but one
#: of each language at least).
SAMPLE_A_LANGUAGE, SAMPLE, SAMPLE_TEXT_CHARS, MOST_LANGUAGES = 256, 32_768, 16_384, 8192
LANDMARKS_A_LANGUAGE, LANDMARKS = 32, 1024
RIDGE = 1e-2
#: Texts that are scored at once; n-grams of a text, and of the landmarks, whose weights are summed at once.
BATCH, PIECE, FOLD = 32, 1 << 16, 1 << 12


def table_bits(languages: int) -> int:
    return min(TABLE_BITS, (MOST_WEIGHTS // max(1, languages)).bit_length() - 1)


def gram_codes(text: str, bits: int = TABLE_BITS) -> Iterator[np.ndarray]:
    """For each length of the spectrum the hashed codes of all n-grams of a whole text, lower-cased."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    for n in SPECTRUM:
        if len(raw) >= n:
            code = raw[: len(raw) - n + 1].copy()
            for i in range(1, n):
                code <<= 8
                code |= raw[i : len(raw) - n + 1 + i]
            code ^= np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
            code *= np.uint32(0x85EBCA6B)
            code ^= code >> np.uint32(15)
            code *= np.uint32(0xC2B2AE35)
            yield code >> np.uint32(32 - bits)


def present(text: str, bits: int = TABLE_BITS) -> np.ndarray:
    """The distinct codes of a text."""
    return np.unique(np.concatenate([*gram_codes(text, bits), np.zeros(0, dtype=np.uint32)]))


@dataclass(frozen=True)
class Model:
    """slots: feature of each code, or their number for none; weights: features by languages; languages in order.

    A score is linear in the presence of n-grams, so the landmarks with their weights are folded into
    one row of weights for each n-gram once the fit is done.
    """

    slots: np.ndarray
    weights: np.ndarray
    languages: tuple[str, ...]

    @property
    def bits(self) -> int:
        return len(self.slots).bit_length() - 1

    def features(self, texts: list[str]) -> np.ndarray:
        """Presence vectors over the landmarks' n-grams, divided by the root of the number of all n-grams of the text."""
        out = np.zeros((len(texts), len(self.weights) + 1), dtype=np.float32)
        for row, text in zip(out, texts, strict=True):
            codes = present(text, self.bits)
            row[self.slots[codes]] = 1 / max(1, len(codes)) ** 0.5
        return out[:, :-1]

    def scores(self, texts: list[str]) -> np.ndarray:
        """One-versus-rest scores, a row for each text: a product of sparse presence rows and the weights."""
        out = np.zeros((len(texts), len(self.languages)), dtype=np.float32)
        last = np.zeros(len(self.slots), dtype=np.int32)
        for row, text in zip(out, texts, strict=True):
            codes = np.concatenate([*gram_codes(text, self.bits), np.zeros(0, dtype=np.uint32)])
            places = np.arange(len(codes), dtype=np.int32)
            last[codes] = places
            once = codes[last[codes] == places]  # codes count at their last place
            found = self.slots[once]
            found = found[found < len(self.weights)]
            for at in range(0, len(found), PIECE):
                row += self.weights[found[at : at + PIECE]].sum(axis=0)
            row /= max(1, len(once)) ** 0.5
        return out


class _Landmarks:
    """Landmarks as lists of the landmarks that have each n-gram."""

    def __init__(self, codes: list[np.ndarray], bits: int) -> None:
        self.n, self.sizes = len(codes), np.array([max(1, len(c)) for c in codes]) ** 0.5
        every, mark = np.concatenate(codes), np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        order = np.argsort(every, kind="stable")
        self.marks = mark[order]
        self.chosen, self.first, self.counts = np.unique(every[order], return_index=True, return_counts=True)
        self.slots = np.full(1 << bits, len(self.chosen), dtype=np.int32)
        self.slots[self.chosen] = np.arange(len(self.chosen))

    def kernel(self, codes: np.ndarray) -> np.ndarray:
        """A text's kernel with every landmark, from its distinct codes."""
        found = self.slots[codes]
        found = found[found < len(self.chosen)]
        counts = self.counts[found]
        total = np.cumsum(counts)
        places = np.arange(total[-1] if len(total) else 0) - np.repeat(total - counts, counts) + np.repeat(self.first[found], counts)
        common = np.bincount(self.marks[places], minlength=self.n)
        return common / (self.sizes * max(1, len(codes)) ** 0.5)

    def fold(self, weights: np.ndarray) -> np.ndarray:
        """The weights of landmarks as weights of their n-grams."""
        scaled = weights / self.sizes[:, None]
        out = np.zeros((len(self.chosen), weights.shape[1]), dtype=np.float32)
        for at in range(0, len(self.chosen), FOLD):
            first, end = self.first[at], self.first[min(at + FOLD, len(self.chosen)) - 1] + self.counts[min(at + FOLD, len(self.chosen)) - 1]
            out[at : at + FOLD] = np.add.reduceat(scaled[self.marks[first:end]], self.first[at : at + FOLD] - first)
        return out


def fit(texts: list[str], languages: list[str], landmarks_a_language: int = LANDMARKS_A_LANGUAGE, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression of +1/-1 targets in the Nyström space of the landmarks.

    The kernel of two texts is the number of n-grams (of all lengths of the spectrum) that both
    have, normalised to 1 for a text with itself. Landmarks are the first texts of each language.
    With K the landmarks' kernel, a text's k(x) becomes K^(-1/2) k(x), in which the ridge regression
    is linear. Languages weigh alike, however many texts they have.
    """
    names = tuple(sorted(set(languages)))
    place = {x: i for i, x in enumerate(names)}
    each = max(1, min(landmarks_a_language, LANDMARKS // len(names)))
    of = np.array([place[x] for x in languages])
    marks = [int(i) for k in range(len(names)) for i in np.flatnonzero(of == k)[:each]]
    bits = table_bits(len(names))
    landmarks = _Landmarks([present(texts[i], bits) for i in marks], bits)
    values, vectors = np.linalg.eigh(np.stack([landmarks.kernel(present(texts[i], bits)) for i in marks]))
    good = values > 1e-8 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    mapped = np.stack([landmarks.kernel(present(t, bits)) for t in texts]) @ whiten
    targets = np.where(of[:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
    share = (1.0 / np.bincount(of))[of][:, None]
    gram = mapped.T @ (share * mapped) + ridge * np.eye(mapped.shape[1])
    weights = whiten @ np.linalg.solve(gram, mapped.T @ (share * targets))
    return Model(landmarks.slots, landmarks.fold(weights), names)


def training_sample(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, per_language: int = SAMPLE_A_LANGUAGE) -> list[tuple[str, str]]:
    """(text, language) of at most per_language documents of each language and SAMPLE in all, the same at every run.

    Ids fall into so many buckets by their hash; the least hash of each bucket and language is
    taken (an aggregation of ids alone), and then these texts are read, up to SAMPLE_TEXT_CHARS.
    Of over MOST_LANGUAGES languages those of most documents are learned.
    """
    h = F.xxhash64(F.col(id_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    labelled = docs.where(F.col(lang_col).isNotNull() & text.rlike(r"\p{L}"))
    sizes = labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    names = [r["lang"] for r in sizes.collect()]
    if not names:
        return []
    buckets = max(1, min(per_language, SAMPLE // len(names)))
    learned = docs.sparkSession.createDataFrame([(x,) for x in names], "_lang string")
    labelled = labelled.join(F.broadcast(learned), F.col(lang_col) == F.col("_lang"), "left_semi")
    least = labelled.groupBy(F.col(lang_col).alias("_lang"), F.pmod(h, F.lit(buckets)).alias("b")).agg(F.min(h).alias("_h")).select("_lang", "_h")
    rows = labelled.join(F.broadcast(least), (F.col(lang_col) == F.col("_lang")) & (h == F.col("_h"))).select(F.col("_h").alias("h"), F.col(lang_col).alias("lang"), F.substring(text, 1, SAMPLE_TEXT_CHARS).alias("text"))
    rows = rows.groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["lang"], r["h"]))]


def identify(docs: DataFrame, model: Model | None, *, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """docs with the predicted language and its score.

    A text is scored whole. The score is the winning one-versus-rest value, mapped from [-1, 1] to
    [0, 1] and clipped. A text with none of the landmarks' n-grams gets the first language and 0.5.
    Null texts, texts without a letter, and all texts where there is no model are
    `und` with score 0. Columns of the output's names are replaced; rows stay as they are.
    """
    if model is None or not model.languages:
        got = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast((model.slots, model.weights, model.languages))  # at most 2^TABLE_BITS and MOST_WEIGHTS numbers of 4 bytes

        @F.pandas_udf("struct<lang string, score double>")
        def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            m = Model(*shared.value)
            for s in texts:
                langs, scores = [], []
                known = [t or "" for t in s]
                for i in range(0, len(known), BATCH):
                    values = m.scores(known[i : i + BATCH])
                    best = values.argmax(axis=1)
                    langs += [m.languages[b] for b in best]
                    scores += np.clip((values[np.arange(len(best)), best] + 1) / 2, 0, 1).tolist()
                yield pd.DataFrame({"lang": langs, "score": scores})

        text = F.col(text_col)
        known = F.coalesce(text, F.lit("")).rlike(r"\p{L}")
        got = _where(known, predict(text))
    rest = [c for c in docs.columns if c not in (lang_name, score_name)]
    return docs.select(*(F.col(c).alias(c) for c in rest), got.alias("_got")).select(*rest, F.col("_got.lang").alias(lang_name), F.col("_got.score").alias(score_name))


def _where(known: Column, got: Column) -> Column:
    return F.when(known, got).otherwise(F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score")))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """The model fitted on training_sample(docs), or None if that is empty."""
    sample = training_sample(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    return fit([t for t, _ in sample], [x for _, x in sample]) if sample else None
