"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a seed and its code point. The vector of
an n-gram binds (multiplies) its letters' vectors, each permuted (rotated) by its place; a text's
vector bundles (adds) the vectors of its n-grams, and a language prototype those of its training
texts. A text gets the language with the highest cosine to its vector; ties go to the smaller name.

All prototypes have unit length and the length of the text's own vector divides every cosine of that
text alike, so the bundle's dot products are summed over the n-grams without forming the bundle.

The score is the best cosine's share of the positive cosines: 0 to 1. Null texts and texts without a
letter are ``und`` with score 0, as is everything if there is nothing to learn from. Words are runs
of letters, lower-cased, with a blank on either side; a one-letter word has an n-gram too. Rows
repeated in training count as often as they occur.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerlake.llm.common import add_columns, once, pieces

DIMENSIONS = 1024
GRAM = 3
UNKNOWN = "und"
BLANK = 32
_REMEMBERED = 40_000


def letter_table() -> np.ndarray:
    """For each code point itself if it is a letter, else the blank."""
    return np.array([c if chr(c).isalpha() else BLANK for c in range(0x110000)], np.int64)


def _letters() -> np.ndarray:
    return once(("letters",), letter_table)


def gram_codes(text: str | None) -> np.ndarray:
    """Codes of the n-grams of a text; each packs GRAM code points of 21 bits. None without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    points = _letters()[np.concatenate([[BLANK], points, [BLANK]])]
    blank = points == BLANK
    points = points[~(blank & np.concatenate([[False], blank[:-1]]))]  # one blank between words
    if len(points) < GRAM:
        return np.zeros(0, np.int64)
    codes = np.zeros(len(points) - GRAM + 1, np.int64)
    for k in range(GRAM):
        codes = codes << 21 | points[k : len(points) - GRAM + 1 + k]
    return codes


def letter_vector(point: int, dimensions: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, point]).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1


class Space:
    """Vectors of n-grams, remembered by code up to a bound."""

    def __init__(self, dimensions: int, seed: int):
        self.dimensions, self.seed = dimensions, seed
        self.of_letter: dict[int, list[np.ndarray]] = {}

    def letter(self, point: int, place: int) -> np.ndarray:
        if point not in self.of_letter:
            plain = letter_vector(point, self.dimensions, self.seed)
            self.of_letter[point] = [np.roll(plain, GRAM - 1 - k) for k in range(GRAM)]
        return self.of_letter[point][place]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """One row for each code."""
        out = np.ones((len(codes), self.dimensions), np.int8)
        for k in range(GRAM):
            points = codes >> (21 * (GRAM - 1 - k)) & 0x1FFFFF
            distinct, at = np.unique(points, return_inverse=True)
            out *= np.stack([self.letter(int(p), k) for p in distinct])[at]
        return out


def bundle(space: Space, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.zeros(space.dimensions, np.float64)
    for k in range(0, len(codes), 4096):
        total += counts[k : k + 4096].astype(np.float64) @ space.vectors(codes[k : k + 4096])
    return total


def _bundles(dimensions: int, seed: int, batches):
    """A bundle for each language in the rows of a task; n-gram counts are held for one slice only."""
    space = once(("space", dimensions, seed), lambda: Space(dimensions, seed))
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in pieces(batch, "_text"):
            codes_of: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("_text").to_pylist()):
                codes_of.setdefault(lang, []).append(gram_codes(text))
            for lang, codes in codes_of.items():
                distinct, counts = np.unique(np.concatenate(codes), return_counts=True)
                sums[lang] = sums.get(lang, 0) + bundle(space, distinct, counts)
    langs = sorted(sums)
    yield pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array([sums[x].tolist() for x in langs], pa.list_(pa.float64()))], names=["lang", "bundle"])


def learn_prototypes(
    labelled: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, seed: int = 7
) -> tuple[list[str], np.ndarray]:
    """Languages and their unit vectors, from all rows with a language.

    The driver gets a vector for each language (``dimensions`` sums), not rows or texts.
    """
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("_text"))
    parts = rows.mapInArrow(partial(_bundles, dimensions, seed), "lang string, bundle array<double>")
    sums = parts.select("lang", F.posexplode("bundle").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x"))
    found = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v")).orderBy("lang").collect()
    langs = [r["lang"] for r in found]
    vectors = np.array([[x["x"] for x in r["v"]] for r in found], np.float64).reshape(len(langs), dimensions)
    norms = np.linalg.norm(vectors, axis=1)
    kept = norms > 0
    return [x for x, k in zip(langs, kept) if k], vectors[kept] / norms[kept, None]


class Judge:
    """Dot products of n-gram vectors with the prototypes, remembered by code."""

    def __init__(self, space: Space, prototypes: np.ndarray):
        self.space, self.prototypes = space, prototypes.T.copy()
        self.codes, self.dots = np.zeros(0, np.int64), np.zeros((0, prototypes.shape[0]))

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Rows of dot products for sorted distinct codes."""
        new = codes[~np.isin(codes, self.codes, assume_unique=True)]
        if len(new):
            dots = np.concatenate([
                self.space.vectors(new[k : k + 4096]).astype(np.float64) @ self.prototypes for k in range(0, len(new), 4096)])
            if len(self.codes) + len(new) > max(_REMEMBERED, len(codes)):
                held = np.isin(self.codes, codes, assume_unique=True)
                self.codes, self.dots = self.codes[held], self.dots[held]
            every, dots = np.concatenate([self.codes, new]), np.concatenate([self.dots, dots])
            order = np.argsort(every)
            self.codes, self.dots = every[order], dots[order]
        return self.dots[np.searchsorted(self.codes, codes)]

    def cosines(self, texts: list[str | None]) -> np.ndarray:
        """For each text a number in proportion to its cosines; NaN without a letter."""
        out = np.full((len(texts), self.prototypes.shape[1]), np.nan)
        for i, text in enumerate(texts):
            codes = gram_codes(text)
            if len(codes):
                distinct, counts = np.unique(codes, return_counts=True)
                out[i] = counts @ self.of(distinct)
        return out


def _predict(langs: list[str], prototypes: np.ndarray, dimensions: int, seed: int):
    judge = Judge(once(("space", dimensions, seed), lambda: Space(dimensions, seed)), prototypes)

    def work(texts):
        if not langs:
            return {"lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts)}
        cosines = judge.cosines(texts)
        blank = np.isnan(cosines[:, 0])
        best = np.where(blank, 0, np.argmax(np.nan_to_num(cosines, nan=-np.inf), axis=1))
        positive = np.maximum(np.nan_to_num(cosines), 0)
        top, total = positive[np.arange(len(texts)), best], positive.sum(axis=1)
        score = np.where(total > 0, top / np.where(total > 0, total, 1), 0.0)
        return {"lang_pred": [UNKNOWN if b else langs[k] for b, k in zip(blank, best)], "score": score.tolist()}

    return work


def identify(
    docs: DataFrame, langs: list[str], prototypes: np.ndarray, text: str = "text", dimensions: int = DIMENSIONS, seed: int = 7,
    keep: list[str] | None = None,
) -> DataFrame:
    """Append ``lang_pred`` and ``score``."""
    return add_columns(docs, text, {"lang_pred": T.StringType(), "score": T.DoubleType()},
                       partial(_predict, langs, prototypes, dimensions, seed), keep)
