"""Quality rules on word statistics and on how well a public vocabulary fits a text.

Every whole text is encoded with a public vocabulary that falls back to bytes. Three measures of
the encoding have rejection bands by script: characters per token, the share of byte-fallback
tokens (those that spell no whole character) and the entropy of the token counts (bits, against
the most that so many tokens can have).
A text whose letters are mostly of a script without a band of its own takes the band ``other``.

A null text has no words and fails the base rules; so do texts of fewer than ten words. Texts
without letters take the band ``other``. Repeated rows are judged alike.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from functools import partial

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kmerlake.llm.bpe import PATTERN
from kmerlake.llm.common import add_columns, once

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: Bands by script: least and most characters per token, most byte-fallback share, least relative entropy. The floors lie between what
#: random letters of the script reach and clean text: for Latin 1.81 against 2.12, the lowest thousandth of the 1,979 documents
#: with quality label 1 among the first 6,000 of sf0.1; for the others, of which the tables hold no text, one plain sentence each.
BANDS = {
    "Latin": (2.05, 9.0, 0.12, 0.40),
    "Cyrillic": (1.6, 9.0, 0.20, 0.30),
    "Greek": (1.55, 7.0, 0.30, 0.30),
    "Arabic": (1.45, 7.0, 0.40, 0.30),
    "Han": (0.6, 4.0, 0.80, 0.30),
    "Thai": (0.95, 7.0, 0.30, 0.30),
    "Hangul": (0.9, 5.0, 0.60, 0.30),
    "Devanagari": (0.75, 7.0, 0.78, 0.30),
    "Hebrew": (1.5, 7.0, 0.30, 0.30),
    "Hiragana": (1.05, 5.0, 0.32, 0.30),
    "Katakana": (1.05, 5.0, 0.32, 0.30),
    "other": (0.25, 9.0, 0.95, 0.20),
}
MAIN = ("Latin", "Cyrillic", "Greek", "Arabic", "Han")
REST = tuple(name for name in BANDS if name not in MAIN and name != "other")
_SCRIPT = regex.compile("|".join(rf"(\p{{{name}}}+)" for name in MAIN) + r"|(\p{L}+)")
_REST = regex.compile("|".join(rf"(\p{{{name}}}+)" for name in REST))
COLUMNS = {
    "n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(), "n_dup_lines": T.LongType(),
    "n_repeat_words": T.LongType(), "base_failed": T.BooleanType(), "script": T.StringType(), "n_tokens": T.LongType(),
    "chars_per_token": T.DoubleType(), "byte_share": T.DoubleType(), "token_entropy": T.DoubleType(), "kept": T.BooleanType()}


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of five found twice or more, the first place included."""
    windows = list(zip(*[words[i:] for i in range(WINDOW)]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    marked, end = 0, 0
    for i, window in enumerate(windows):
        if times[window] > 1:
            marked += i + WINDOW - max(i, end)
            end = i + WINDOW
    return marked


def duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def base_measures(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    words = text.encode().split()  # bytes split at ASCII white space
    chars = len(text) - sum(map(text.count, SPACES))
    repeated = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED * len(words)
    return len(words), chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated, failed


def main_script(text: str) -> str:
    """Main script of most letters, or ``other``; ties go to the order of MAIN."""
    if text.isascii():
        return "Latin" if any(map(str.isalpha, text)) else "other"
    counts = Counter()
    for found in _SCRIPT.finditer(text):
        counts[found.lastindex] += len(found.group())
    if not counts:
        return "other"
    return (*MAIN, "other")[min(counts, key=lambda k: (-counts[k], k)) - 1]


def band_script(text: str) -> str:
    """The main script, or the commonest of REST where that is ``other``."""
    script = main_script(text)
    if script != "other" or text.isascii():
        return script
    counts = Counter()
    for found in _REST.finditer(text):
        counts[found.lastindex] += len(found.group())
    return REST[min(counts, key=lambda k: (-counts[k], k)) - 1] if counts else "other"


def encoding_measures(ids: np.ndarray, n_chars: int, byte_ids: np.ndarray) -> tuple[float, float, float]:
    """Characters per token, byte-fallback share and relative entropy of the token counts."""
    n = len(ids)
    if n == 0:
        return 0.0, 0.0, 0.0
    counts = np.unique(ids, return_counts=True)[1]
    share = counts / n
    bits = float(-(share * np.log2(share)).sum())
    most = np.log2(min(n, len(byte_ids)))
    return n_chars / n, float(byte_ids[ids].mean()), bits / float(most) if most > 0 else 1.0


def within(bands: dict, script: str, measures: tuple[float, float, float]) -> bool:
    low, high, most_bytes, least_entropy = bands[script if script in bands else "other"]
    fertility, byte_share, entropy = measures
    return low <= fertility <= high and byte_share <= most_bytes and entropy >= least_entropy


def _whole(piece: bytes) -> bool:
    try:
        piece.decode()
    except UnicodeDecodeError:
        return False
    return True


def load_ranks(path: str, pattern: str):
    """Encoder of a rank file (base64 piece and id in each line) and, by id, which pieces are bytes."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(piece): int(i) for piece, i in map(bytes.split, file)}
    byte_ids = np.zeros(1 + max(ranks.values()), bool)
    byte_ids[[i for piece, i in ranks.items() if not _whole(piece)]] = True
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), byte_ids


#: Blanks in a row from which a text is cut into pieces here: the encoder's own matcher runs out of stack on much longer ones.
_BLANKS = re.compile(r"\s{20000}")


def encode(model: tiktoken.Encoding, pattern: regex.Pattern, text: str) -> list[int]:
    if not _BLANKS.search(text):
        return model.encode_ordinary(text)
    return [i for piece in pattern.findall(text) for i in model._encode_single_piece(piece)]


def _kernel(path: str, pattern: str, bands: dict):
    model, byte_ids = once(("ranks", path, pattern), lambda: load_ranks(path, pattern))
    cut = regex.compile(pattern)

    def work(texts):
        rows = []
        for text in texts:
            base = base_measures(text)
            text = text or ""
            script = band_script(text)
            ids = np.array(encode(model, cut, text), np.int64)
            fit = encoding_measures(ids, len(text), byte_ids)
            rows.append((*base, script, len(ids), *fit, not base[-1] and within(bands, script, fit)))
        return dict(zip(COLUMNS, zip(*rows))) if rows else {name: [] for name in COLUMNS}

    return work


def quality_rules(
    df: DataFrame, path: str, text: str = "text", bands: dict | None = None, pattern: str = PATTERN, keep: list[str] | None = None
) -> DataFrame:
    """Append the measures of COLUMNS. ``path``: rank file, at the same place on every executor."""
    return add_columns(df, text, COLUMNS, partial(_kernel, path, pattern, dict(bands or BANDS)), keep)
