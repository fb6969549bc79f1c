"""Statistics of one text, computed in a worker on whole texts."""

from __future__ import annotations

import numpy as np

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
BLANK = b" \t\n\x0b\x0c\r"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "mark_rate", "bang_rate", "line_words", "ends_rate", "distinct_rate", "longest_word", "non_ascii_rate")
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def repeated_words(ids: np.ndarray) -> int:
    """Words inside 3-word windows that the text has twice or more."""
    if len(ids) < 4:
        return 0
    h = ids.view(np.uint64)
    with np.errstate(over="ignore"):
        w = h[:-2] * _M[0] + (h[1:-1] ^ (h[1:-1] >> np.uint64(29))) * _M[1] + (h[2:] ^ (h[2:] >> np.uint64(31))) * _M[2]
    order = np.argsort(w)
    s = w[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def statistics(data: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """BASE as whole numbers, FEATURES as floats."""
    words = data.split()
    n = len(words)
    raw = np.frombuffer(data, np.uint8)
    count = np.bincount(raw, minlength=256)
    starts = len(raw) - int(count[0x80:0xC0].sum())  # code points
    word_chars = starts - int(count[list(BLANK)].sum())
    symbols = int(count[list(SYMBOLS)].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    ids = np.fromiter(map(hash, words), np.int64, n)
    repeat = repeated_words(ids)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    marks = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum())
    w, c, m = max(n, 1), max(word_chars, 1), max(len(lines), 1)
    features = (
        np.log1p(n), word_chars / w, symbols / w, dup / m, repeat / w, upper / max(upper + lower, 1), int(count[48:58].sum()) / c, marks / c, int(count[33]) / w,
        min(n / m, 200.0), sum(x[-1:] in b".!?:\"" for x in lines) / m, len(set(words)) / w, min(max(map(len, words), default=0), 200), int(count[0x80:].sum()) / max(len(raw), 1),
    )
    return (n, word_chars, symbols, dup, repeat), tuple(map(float, features))
