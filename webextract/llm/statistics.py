"""Statistics of a whole text, shared by the quality operators."""

from __future__ import annotations

import numpy as np

SYMBOLS = "#*$%&|<>"
_SYMBOL_BYTES = np.frombuffer(SYMBOLS.encode(), np.uint8)
_WHITE_BYTES = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)
_MARKS = np.frombuffer(b".,;:!?\"'()-", np.uint8)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The sign says how the chance of a good text may change with the ratio; 0: freely.
RATIOS = {
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_word_share": -1,
    "same_as_before_share": -1,
    "top_word_share": -1,
    "distinct_share": 0,
    "mean_word_chars": 0,
    "upper_share": 0,
    "bang_per_word": -1,
    "digit_share": 0,
    "mark_share": 0,
    "words_per_line": 0,
    "log_words": 0,
    "wide_share": 0,
    "markup_per_word": -1,
}


def _windows(ids: np.ndarray, kinds: int) -> np.ndarray:
    """A number for each run of three words, equal for equal runs."""
    if kinds < 2_000_000:
        return (ids[:-2] * kinds + ids[1:-1]) * kinds + ids[2:]
    pairs = np.unique(ids[:-1] * kinds + ids[1:], return_inverse=True)[1]
    return pairs[:-1] * kinds + ids[2:]


def text_statistics(text: str) -> tuple[tuple[int, ...], list[float]]:
    """The counts named COUNTS, and the ratios named RATIOS."""
    return text_statistics_and_words(text)[:2]


def text_statistics_and_words(text: str) -> tuple[tuple[int, ...], list[float], dict[bytes, int]]:
    """As text_statistics(), and the different words."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    of_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    word_chars = len(text) - int(of_byte[_WHITE_BYTES].sum())
    n_symbols = int(of_byte[_SYMBOL_BYTES].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_dup_lines = len(lines) - len(set(lines))
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    n_repeat = 0
    if n >= 3:
        codes = _windows(ids, len(known))
        order = np.sort(codes)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            again = np.isin(codes, twice)
            covered = np.zeros(n, dtype=bool)
            for k in range(3):
                covered[k : n - 2 + k] |= again
            n_repeat = int(covered.sum())
    w, letters = max(n, 1), max(word_chars, 1)
    ratios = [
        n_symbols / w,
        n_dup_lines / max(len(lines), 1),
        n_repeat / w,
        float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0,
        float(np.bincount(ids).max() / n) if n else 0.0,
        len(known) / w,
        word_chars / w,
        float(of_byte[65:91].sum() / letters),
        float(of_byte[33] / w),
        float(of_byte[48:58].sum() / letters),
        float(of_byte[_MARKS].sum() / letters),
        n / max(len(lines), 1),
        float(np.log1p(n)),
        float(of_byte[192:].sum() / letters),
        float((of_byte[124] + of_byte[60] + of_byte[62]) / w),
    ]
    return (n, word_chars, n_symbols, n_dup_lines, n_repeat), ratios, known
