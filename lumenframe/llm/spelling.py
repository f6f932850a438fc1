"""Operator 12: spelling variants by an Aho-Corasick search for the words' halves.

Two words are near if they differ by exactly one inserted, deleted or replaced
code point.  Cut the shorter word (of equally long ones either) in two: the
difference lies in one segment, so the other stands unchanged in the longer
word, the left one at its start, the right one at its end.  Automata hold both
segments of every word; each word is scanned for them, a match counts if it
stands at the start or the end and the lengths differ by at most one, and then
the rest of the two words is compared.  A pair is taken only where the first
difference lies in the segment that did not have to match, so it is found once.

The words go to shards by segment, and a word is scanned by the shards that can
hold a segment at its own start or end: those that its first or last code points
hash to, for each length that the other word may have.  A segment that many
words share (all that begin or end alike) makes its shard large; therefore
segments that more than ``most`` words have or look for are cut again: beside
the unchanged segment, half of the other one must stand unchanged too, next to
it or at the far end.  That goes on until few words share what must match, or a
single code point is left open, so no group of words meets in all its pairs.

Words are counted over whole texts.  Null texts and texts without letters hold
none; repeated rows count as often as they occur; a null doc_id is written as
nothing before the colon; an empty table gives no words.  Forms are followed by
doubling: each round replaces a word's root by its root's root.  Every form has
at least ``times`` the occurrences, so the chains are short and have no rings.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm._text import as_bytes, slices, small_batches
from lumenframe.storage import cut_lineage, drop

LETTERS = "a-zÀ-ÿ"  # once A to Z are lower-cased
SHARD_ROWS = 100_000
MOST = 64
_HELD = 200_000  # words that a task counts before it passes them on


def damaged(run: str, doc_sum: int, one_in: int = 31) -> str:
    """The run, in one of ``one_in`` cases without a code point, by the checksum of ``<doc_id>:<run>``; ``doc_sum`` is that of its first part."""
    h = zlib.crc32(run.encode(), doc_sum)
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count_pass(least_length: int):
    """Counts of words, added up over documents as far as memory allows; a run that is too short to count is never made."""
    runs = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                doc_sum = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for found, n in Counter(runs.findall(text.decode("utf-8", "surrogatepass"))).items():
                    word = damaged(found, doc_sum)
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) >= _HELD:
                    yield passed()
        if held:
            yield passed()

    return run


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2) -> DataFrame:
    """``word, n`` over all texts."""
    small_batches(docs)
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = rows.mapInArrow(_count_pass(least_length), "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _key() -> Column:
    """What must stand unchanged: ``a`` code points at the start and ``size - b`` at the end, of words of ``size`` or one more."""
    start, end = F.col("word").substr(F.lit(1), F.col("a")), F.col("word").substr(F.length("word") - F.col("size") + F.col("b") + 1, F.col("size") - F.col("b"))
    return F.xxhash64("size", "a", "b", start, end)


def _cut(rows: DataFrame) -> DataFrame:
    """Both halves of each row's open segment, where they hold a code point, in place of it."""
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    halves = F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b").alias("b")))
    cut = rows.select("word", "n", "size", F.explode(halves).alias("open")).select("word", "n", "size", "open.*").where("a < b")
    return cut.withColumn("key", _key())


def segment_rows(words: DataFrame, most: int = MOST, max_broadcast: int = 1 << 20) -> DataFrame:
    """``word, n, size, a, b, key``: a row for each word and segment of words of ``size`` that it has or may be near to.

    ``size`` is the word's length, or one less; ``a`` to ``b`` is the segment
    that may differ.  Keys of more than ``most`` rows are cut again, unless a
    single code point is open.  Up to ``max_broadcast`` of them (8 bytes each)
    are sent to the executors.
    """
    size = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("size")
    rows = _cut(words.select("word", "n", size, F.lit(0).alias("a")).withColumn("b", F.col("size")))
    leaves, used = [], []
    while True:
        many = rows.where("b - a > 1").groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > most)
        many = cut_lineage(many.select("key"), "spelling-many")
        n = many.count()
        used.append(many)
        if not n:
            leaves.append(rows)
            break
        known = F.broadcast(many) if n <= max_broadcast else many
        marked = F.col("b") - F.col("a") > 1
        leaves.append(rows.join(known, "key", "left_anti").union(rows.where(~marked).join(known, "key", "left_semi")))
        rows = cut_lineage(_cut(rows.where(marked).join(known, "key", "left_semi")), "spelling-rows")
        used.append(rows)
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    out.scratch = used
    return out


class Shard:
    """Automaton of the segments of some words, and the words by what they leave open."""

    def __init__(self, rows: list[tuple[str, int, int, int, int]]):
        self.words: dict[str, int] = {}
        owners: dict[tuple, list[tuple[str, str, int]]] = {}
        for word, n, size, a, b in rows:
            self.words[word] = n
            if len(word) == size:
                owners.setdefault((size, a, b, word[:a], word[b:]), []).append((word[a:b], word, n))
        # a segment's width, and by the owners' size what goes with it at a word's start, and at a word's end
        patterns: dict[str, tuple[int, dict, dict]] = {}
        for (size, a, b, start, end), own in owners.items():
            first = len(start) >= len(end)
            segment, further = (start, end) if first else (end, start)
            sides = patterns.setdefault(segment, (len(segment), {}, {}))
            sides[1 if first else 2].setdefault(size, []).append((further, a, b, own))
        self.automaton = ahocorasick.Automaton()
        for segment, sides in patterns.items():
            self.automaton.add_word(segment, sides)
        if patterns:
            self.automaton.make_automaton()

    def near(self) -> Iterator[tuple[str, int, str, int]]:
        """Each pair of near words that share a segment here, with their counts."""
        if not len(self.automaton):
            return
        for word, n in self.words.items():
            length = len(word)
            for last, (width, starts, ends) in self.automaton.iter(word):
                if last == width - 1:
                    sides, fits = starts, word.endswith
                elif last == length - 1:
                    sides, fits = ends, word.startswith
                else:
                    continue
                for longer in (0, 1):
                    for further, a, b, own in sides.get(length - longer, ()):
                        if fits(further):
                            open_, final = word[a : b + longer], b + longer == length
                            for segment, other, m in own:
                                if (longer or other < word) and _one_edit(segment, open_, longer, final):
                                    yield word, n, other, m


def _one_edit(a: str, b: str, longer: int, final: bool) -> bool:
    """Whether ``b`` is ``a`` with one code point replaced (``longer`` 0) or inserted (1).

    The first difference lies in ``a``; at its end only if nothing follows (``final``).
    """
    c, size = 0, len(a)
    while c < size and a[c] == b[c]:
        c += 1
    if longer:
        return (c < size or final) and a[c:] == b[c + 1 :]
    return c < size and a[c + 1 :] == b[c + 1 :]


_NEAR = "word string, n long, other string, other_n long"


def _near_pass(rows: pa.Table) -> pa.Table:
    shard = Shard(list(zip(*(rows.column(c).to_pylist() for c in ("word", "n", "size", "a", "b")))))
    pairs = list(shard.near())
    columns = [pa.array([p[k] for p in pairs], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))]
    return pa.Table.from_arrays(columns, names=["word", "n", "other", "other_n"])


def near_words(words: DataFrame, most: int = MOST, shard_rows: int = SHARD_ROWS, max_broadcast: int = 1 << 20) -> DataFrame:
    """``word, n, other, other_n``: each pair of near words of ``word, n`` once."""
    rows = segment_rows(words, most, max_broadcast)
    least = 2 * words.sparkSession.sparkContext.defaultParallelism
    shards = max(least, -(-6 * words.count() // shard_rows))  # about six rows a word
    found = rows.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int")).select("shard", "word", "n", "size", "a", "b")
    found = cut_lineage(found.groupBy("shard").applyInArrow(_near_pass, _NEAR), "spelling-near")
    drop(*rows.scratch)
    return found


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words with a form in ``word, form``: the end of the chain of forms."""
    now = cut_lineage(forms.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut_lineage(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        drop(now)
        now = step.drop("moved")
        now.scratch_path = step.scratch_path
        if step.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, times: int = 10, **options) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of at least ``least_length`` code points and ``least_count`` occurrences.

    ``form``: the near word of most occurrences (of several the least), if it
    has at least ``times`` the word's; ``root``: the last of the forms' chain.
    """
    words = cut_lineage(word_counts(docs, least_length, least_count), "spelling-words")
    pairs = near_words(words, **options)
    both = pairs.union(pairs.select("other", "other_n", "word", "n"))
    alone = words.select("word", "n", F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("other_n"))
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))))
    found = both.union(alone).groupBy("word").agg(F.max("n").alias("n"), F.count("other").alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= times * F.col("n")
    found = found.select("word", F.when(enough, F.col("best.form")).alias("form"), "n", "n_near", F.when(enough, -F.col("best.less")).alias("form_n"))
    found = cut_lineage(found, "spelling-forms")
    drop(words, pairs)
    ends = roots(found)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
