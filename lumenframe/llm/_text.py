"""Words and word shingles of whole texts as 64-bit hashes, in numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  All texts of a
block are hashed at once: a word's value is the polynomial of its bytes modulo
2**64, taken from running sums, then mixed.  Blocks hold about ``BLOCK`` bytes,
so memory doesn't depend on the number of texts; a longer text is cut at white
space and its words are joined again.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 18
SHINGLE = 5
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MULT = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(1, SHINGLE + 1)], dtype=np.uint64)
#: glibc's; other C libraries have none.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, key: str) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; kept, as long as the longest block so far."""
    have = _powers.get(key)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK + 4096), base, dtype=np.uint64)
        steps[0] = 1
        _powers[key] = have = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _pieces(text: bytes) -> Iterator[bytes]:
    """``text`` in parts of about BLOCK bytes, cut only at white space."""
    at = 0
    while len(text) - at > BLOCK:
        cut = at + BLOCK
        while cut < len(text) and not _SPACE[text[cut]]:
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def _hash_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of ``block`` and the place where it starts."""
    buf = np.frombuffer(block, dtype=np.uint8)
    gap = _SPACE[buf]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    if not gap[-1]:
        edge = np.concatenate((edge, [len(buf)]))
    start, end = edge[::2], edge[1::2]
    run = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power(_P, len(buf), "p"), dtype=np.uint64, out=run[1:])
    value = (run[end] - run[start]) * _power(_P_INV, len(buf), "i")[start]
    return mix(value + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), start


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, one after another, and where each text's begin (one entry more than texts)."""
    parts: list[np.ndarray] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    held: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            block = b"\n".join([texts[i] for i in held])
            if block:
                words, start = _hash_block(block)
                lengths = np.array([len(texts[i]) + 1 for i in held], dtype=np.int64)
                counts[held] = np.diff(np.searchsorted(start, np.concatenate(([0], np.cumsum(lengths)))))
                parts.append(words)
        held, size = [], 0

    for i, text in enumerate(texts):
        if len(text) > BLOCK:
            flush()
            for piece in _pieces(text):
                if piece:
                    words, _ = _hash_block(piece)
                    counts[i] += len(words)
                    parts.append(words)
            continue
        held.append(i)
        size += len(text) + 1
        if size > BLOCK:
            flush()
    flush()
    offsets = np.concatenate(([0], np.cumsum(counts)))
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)), offsets


def window_hashes(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words inside one text, in text order, with offsets."""
    n = np.diff(offsets)
    total = len(words)
    if total < width:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    value = np.zeros(total - width + 1, dtype=np.uint64)
    for k in range(width):
        value += words[k : total - width + 1 + k] * _MULT[k]
    inside = np.ones(total - width + 1, dtype=bool)
    ends = offsets[1:][n > 0]
    for k in range(1, width):
        bad = ends - k
        inside[bad[(bad >= 0) & (bad < len(inside))]] = False
    counts = np.maximum(n - width + 1, 0)
    return mix(value[inside]), np.concatenate(([0], np.cumsum(counts)))


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Five-word shingle hashes in text order, with offsets; fewer words make one shingle, none make none."""
    words, offsets = word_hashes(texts)
    n = np.diff(offsets)
    flat, at = window_hashes(words, offsets, SHINGLE)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if not len(short):
        return flat, at
    whole = np.array([_whole(words[offsets[i] : offsets[i + 1]]) for i in short], dtype=np.uint64)
    counts = np.diff(at)
    flat = np.insert(flat, at[short], whole)
    counts[short] = 1
    return flat, np.concatenate(([0], np.cumsum(counts)))


def _whole(words: np.ndarray) -> int:
    value = len(words)
    for w in words.tolist():
        value = (value * 0xFF51AFD7ED558CCD + w) % (1 << 64)
        value ^= value >> 33
    return value


def distinct_sets(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes sorted and without repeats, with offsets."""
    flat = flat.copy()
    bounds = at.tolist()
    for a, b in zip(bounds, bounds[1:]):
        if b - a > 1:
            flat[a:b].sort()
    if not len(flat):
        return flat, at
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    first = at[:-1][np.diff(at) > 0]
    new[first] = True
    kept = np.concatenate(([0], np.cumsum(new)))
    return flat[new], kept[at]


def as_bytes(column, lower: bool = True) -> list[bytes]:
    """Texts of an Arrow string column as UTF-8; null counts as empty.  ``lower`` folds A-Z only."""
    found = [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in column.to_pylist()]
    return [x.lower() for x in found] if lower else found


def slices(batches, column: str = "text", limit: int = 2 << 20):
    """Arrow batches cut so that ``column`` holds about ``limit`` bytes in each, whatever the rows' lengths."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.flatnonzero(np.diff(sizes // limit)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a)
    release_memory()


def release_memory() -> None:
    """Give what a task has freed back to the system: workers live on, and several share an executor's memory."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def small_batches(df) -> None:
    """Let the session hand Python workers Arrow batches of at most 4 MB; rows of long texts would otherwise make batches of any size."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
