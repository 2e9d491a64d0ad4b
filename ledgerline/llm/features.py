"""Features of whole texts, computed for many texts at once with array operations."""

from __future__ import annotations

import numpy as np

from ledgerline.llm.bpe import LETTER, NUMBER, OTHER, WHITE, classes, code_points, word_hashes

NAMES = (
    "log_words", "word_length", "upper", "digits", "symbols", "white", "distinct_words", "distinct_pairs", "top_word", "same_neighbour", "symbol_runs",
    "lone_symbols", "bangs", "capital_words", "short_words", "log_lines", "distinct_lines", "line_words", "stops", "long_words",
)


def words_of(cp: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, end) of each run of letters and digits."""
    kind = classes()[cp]
    sign = (kind == LETTER) | (kind == NUMBER)
    mark = np.zeros(len(cp) + 1, bool)
    mark[0] = True
    mark[ends] = True
    mark[1:-1] |= sign[1:] != sign[:-1]
    starts = np.flatnonzero(mark[:-1])
    stops = np.append(starts[1:], len(cp))
    keep = sign[starts]
    starts, stops = starts[keep], stops[keep]
    return np.searchsorted(ends, starts, "right"), starts, stops


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of each lower-cased word."""
    cp, ends = code_points([t.lower() for t in texts])
    if not len(cp):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    of, starts, stops = words_of(cp, ends)
    return of, word_hashes(cp, starts, stops)


def _distinct(of: np.ndarray, names: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text the number of distinct names and the count of the most frequent one."""
    if not len(of):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((names, of))
    a, b = of[order], names[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    begin = np.flatnonzero(new)
    top = np.zeros(n)
    np.maximum.at(top, a[begin], np.diff(np.append(begin, len(a))))
    return np.bincount(a[begin], minlength=n), top


def quality_features(texts: list[str]) -> np.ndarray:
    """len(texts) x len(NAMES) numbers; an empty text has zeros."""
    n = len(texts)
    cp, ends = code_points(texts)
    if not len(cp):
        return np.zeros((n, len(NAMES)))
    owner = np.repeat(np.arange(n), np.diff(np.concatenate([[0], ends])))
    count = lambda mask: np.bincount(owner[mask], minlength=n).astype(float)
    kind = classes()[cp]
    other = kind == OTHER
    signs = np.maximum(1, np.bincount(owner, minlength=n)).astype(float)
    upper = (cp >= 65) & (cp <= 90)
    symbol = other & ~np.isin(cp, [ord(c) for c in ".,;:'\"-?()"])
    run = np.zeros(len(cp), bool)
    run[2:] = symbol[2:] & (cp[2:] == cp[1:-1]) & (cp[1:-1] == cp[:-2])
    white_before = np.ones(len(cp), bool)
    white_before[1:] = kind[:-1] == WHITE
    white_after = np.ones(len(cp), bool)
    white_after[:-1] = kind[1:] == WHITE
    of, starts, stops = words_of(cp, ends)
    words = np.maximum(1, np.bincount(of, minlength=n)).astype(float)
    size = stops - starts
    upto = np.concatenate([[0], np.cumsum(upper)])
    capital = (upto[stops] - upto[starts] == size) & (size > 1)
    names = word_hashes(cp, starts, stops)
    pair = of[1:] == of[:-1]
    different, top = _distinct(of, names, n)
    pairs, _ = _distinct(of[:-1][pair], (names[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + names[1:])[pair], n)
    line_end = np.append(np.flatnonzero(cp == 10) + 1, ends)
    line_end = np.unique(line_end)
    line_start = np.concatenate([[0], line_end[:-1]])
    line_of = np.searchsorted(ends, line_start, "right")
    lines = np.maximum(1, np.bincount(line_of, minlength=n)).astype(float)
    distinct_lines, _ = _distinct(line_of, word_hashes(cp, line_start, line_end), n)
    cols = [
        np.log1p(words), np.bincount(of, size, n) / words, count(upper) / signs, count(kind == NUMBER) / signs, count(symbol) / signs, count(kind == WHITE) / signs, different / words, pairs / words, top / words,
        np.bincount(of[1:][pair & (names[1:] == names[:-1])], minlength=n) / words, count(run) / words, count(symbol & white_before & white_after) / words, count(cp == 33) / words, np.bincount(of[capital], minlength=n) / words,
        np.bincount(of[size <= 3], minlength=n) / words, np.log1p(lines), distinct_lines / lines, words / lines, count(np.isin(cp, [46, 63])) / words, np.bincount(of[size > 14], minlength=n) / words,
    ]
    out = np.stack(cols, axis=1)
    out[np.bincount(owner, minlength=n) == 0] = 0
    return out
