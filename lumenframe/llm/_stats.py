"""Statistics of whole texts that the quality operators share."""

from __future__ import annotations

import numpy as np

from lumenframe.llm._text import mix, window_hashes, word_hashes

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


def histogram(texts: list[bytes]) -> np.ndarray:
    """How often each byte occurs in each text."""
    out = np.zeros((len(texts), 256), dtype=np.int64)
    for i, text in enumerate(texts):
        if text:
            out[i] = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    return out


def byte_entropy(hist: np.ndarray) -> np.ndarray:
    """Bits a byte of each text; 0 for an empty one."""
    share = hist / np.maximum(hist.sum(axis=1), 1)[:, None]
    return -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return run[offsets[1:]] - run[offsets[:-1]]


def _again(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values occur twice or more in their text, and which stand there for the first time."""
    n = np.diff(at)
    home = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    key = mix(flat + home * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later = np.concatenate(([False], same))
    twice = later | np.concatenate((same, [False]))
    repeated, first = np.zeros(len(flat), dtype=bool), np.zeros(len(flat), dtype=bool)
    repeated[order], first[order] = twice, ~later
    return repeated, first


def repeated_words(words: np.ndarray, offsets: np.ndarray, width: int = 3) -> np.ndarray:
    """Words of each text inside windows of ``width`` words that the text has twice or more."""
    flat, at = window_hashes(words, offsets, width)
    if not len(flat):
        return np.zeros(len(offsets) - 1, dtype=np.int64)
    repeated, _ = _again(flat, at)
    n = np.diff(at)
    place = np.arange(len(flat)) + np.repeat(offsets[:-1] - at[:-1], n)
    covered = np.zeros(len(words), dtype=bool)
    for k in range(width):
        covered[place[repeated] + k] = True
    return _per_text(covered, offsets)


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def base_rules(texts: list[bytes]) -> dict[str, np.ndarray]:
    words, offsets = word_hashes(texts)
    hist = histogram(texts)
    points = hist.sum(axis=1) - hist[:, 0x80:0xC0].sum(axis=1)
    n_words = np.diff(offsets)
    repeat = repeated_words(words, offsets)
    return {
        "n_words": n_words,
        "word_chars": points - hist[:, list(SPACES)].sum(axis=1),
        "n_symbols": hist[:, list(SYMBOLS)].sum(axis=1),
        "n_dup_lines": np.array([duplicate_lines(x) for x in texts], dtype=np.int64),
        "n_repeat_words": repeat,
        "base_failed": (n_words < 50) | (100 * repeat > 50 * n_words),
    }


FEATURES = (
    "log_words", "log_chars", "word_length", "distinct_words", "symbols", "digits", "upper", "punctuation", "marks",
    "bars", "beyond_ascii", "duplicate_lines", "words_per_line", "repeated_words", "stops", "commas", "longest_byte_share", "byte_entropy",
)


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has zeros."""
    words, offsets = word_hashes(texts)
    hist = histogram(texts)
    size = hist.sum(axis=1)
    per = np.maximum(size, 1)
    n = np.diff(offsets)
    distinct = np.zeros(len(texts), dtype=np.int64)
    if len(words):
        distinct = _per_text(_again(words, offsets)[1], offsets)
    base = base_rules_of(hist)
    lines = hist[:, 10] + 1
    share = hist / per[:, None]
    solid = size - hist[:, list(SPACES)].sum(axis=1)
    nn = np.maximum(n, 1)
    return np.stack(
        [
            np.log1p(n), np.log1p(size), solid / nn, distinct / nn, hist[:, list(SYMBOLS)].sum(axis=1) / per,
            hist[:, 0x30:0x3A].sum(axis=1) / per, hist[:, 0x41:0x5B].sum(axis=1) / per, base / per, hist[:, ord("!")] / per,
            hist[:, ord("|")] / per, hist[:, 0x80:].sum(axis=1) / per, np.array([duplicate_lines(x) for x in texts]) / lines,
            n / lines, repeated_words(words, offsets) / nn, hist[:, ord(".")] / nn, hist[:, ord(",")] / nn, share.max(axis=1), byte_entropy(hist),
        ],
        axis=1,
    )


def base_rules_of(hist: np.ndarray) -> np.ndarray:
    """ASCII punctuation of each text."""
    marks = [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]
    return hist[:, marks].sum(axis=1)
