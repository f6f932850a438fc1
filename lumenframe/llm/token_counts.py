"""Operator 2: token counts, huge documents by overlap resynchronisation.

A document up to ``chunk_chars`` is encoded whole.  A longer one is cut into
chunks that overlap; each chunk is encoded with offsets, and two neighbours are
spliced at a boundary that both of them have inside the overlap and that is
proven stable: it lies directly after white space, which the vocabulary's rules
drop and no token or special string spans, and the last token before and the
first after it are the same in both.  If no such boundary exists, the overlap
is doubled, at last to all that is left, which is the whole encoding.

A null text is empty: 0 bytes, 0 tokens, not over the limit.  Null and repeated
doc_ids and extra columns have no effect; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm._text import as_bytes, slices, small_batches
from lumenframe.llm._tokenizer import WordEncoder, load

_SPACE = " \t\n\x0b\x0c\r"


def _encode(encoder: WordEncoder, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and the characters where each token starts."""
    got = encoder.tokenizer.encode(text, add_special_tokens=False)
    return np.array(got.ids, dtype=np.int64), np.array([a for a, _ in got.offsets], dtype=np.int64)


def _splice(text: str, a: int, left, at: int, right, end: int) -> tuple[int, int, int] | None:
    """A stable boundary of two chunks' encodings inside [at, end): its place, tokens of the left before and of the right before."""
    (l_ids, l_at), (r_ids, r_at) = left, right
    both = np.intersect1d(l_at + a, r_at + at)
    both = both[(both > at) & (both < end)]
    for p in both[np.argsort(np.abs(both - (at + end) // 2), kind="stable")].tolist():
        if text[p - 1] not in _SPACE or text[p] in _SPACE:
            continue
        i, j = int(np.searchsorted(l_at + a, p)), int(np.searchsorted(r_at + at, p))
        if i and j and l_ids[i] == r_ids[j] and l_ids[i - 1] == r_ids[j - 1] and l_at[i - 1] + a == r_at[j - 1] + at:
            return p, i, j
    return None


def encode_long(encoder: WordEncoder, text: str, chunk_chars: int = 65536, overlap: int = 1024) -> np.ndarray:
    """Ids of ``text``, from overlapping chunks."""
    if len(text) <= chunk_chars:
        return _encode(encoder, text)[0]
    out: list[np.ndarray] = []
    a, end = 0, chunk_chars
    left, skip = _encode(encoder, text[a:end]), 0
    while end < len(text):
        width = overlap
        while True:
            at = max(a, end - width)
            until = len(text) if at == a else min(len(text), at + chunk_chars)
            if at == a:  # nothing in common: encode all that is left
                out.append(_encode(encoder, text[a:])[0][skip:])
                return np.concatenate(out)
            right = _encode(encoder, text[at:until])
            found = _splice(text, a, left, at, right, end)
            if found and found[1] >= skip:
                break
            width *= 2
        _, i, j = found
        out.append(left[0][skip:i])
        a, end, left, skip = at, until, right, j
    out.append(left[0][skip:])
    return np.concatenate(out)


def _count_pass(path: str, chunk_chars: int, overlap: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path)
        width = encoder.width
        for batch in slices(batches):
            texts = as_bytes(batch.column("text"), lower=False)
            huge = [len(t) > chunk_chars for t in texts]
            plain = iter(encoder.encode([t for t, h in zip(texts, huge) if not h]))
            n = []
            for t, h in zip(texts, huge):
                n.append(len(encode_long(encoder, t.decode("utf-8", "surrogatepass"), chunk_chars, overlap)) if h else len(next(plain)) // width)
            n = np.array(n, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, chunk_chars: int = 16384, overlap: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row; texts over ``chunk_chars`` bytes are cut."""
    small_batches(docs)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(_count_pass(vocabulary, chunk_chars, overlap, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
