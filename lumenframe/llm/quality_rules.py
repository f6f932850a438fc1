"""Operator 10: quality rules with cross-document line frequency.

Lines are normalised (A-Z lower-cased, digits to 0, white space to one space)
and hashed; for each host (the ``source`` column) the distinct documents that
hold a line are counted, where documents with one and the same text count once.
A line that more than ``min_docs`` of them hold is boilerplate, whatever the
size of the host.  Boilerplate lines are removed, and a document of which less
than ``keep_share`` of its words is left is rejected, as is one that fails the
base rules (fewer than 50 words, or over half of them in three-word windows
that repeat).

Near copies of one text aren't a template.  Only documents that the plain
counts would reject are looked at for that (``min_words`` words or more: shorter
ones fail the base rules anyway).  Those with at least ``copy_lines`` boilerplate
lines that are over two thirds of all their lines count once for each longest
such line of theirs: of n near copies that miss a line with probability p, about
log n / log (1 / p).  Others that operator 1 joins, as they share 0.8 of their
five-word shingles, count once for each component.  Lines that then no longer
have more than ``min_docs`` stay.  Documents that share a passage, or a template
of a few lines, beside text of their own are below that similarity until it is
eight ninths of them, and count one by one.

A null text is empty and fails the base rules; a null source is a host of its
own; repeated rows get the same verdict; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm._stats import base_rules
from lumenframe.llm._text import as_bytes, slices, small_batches
from lumenframe.llm.ngram_join import ngram_jaccard_join
from lumenframe.storage import cut_lineage

_FOLD = bytes(x + 32 if 65 <= x <= 90 else 48 if 48 <= x <= 57 else x for x in range(256))
_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _seed(source: str | None) -> int:
    return xxhash.xxh64_intdigest(b"\xff" if source is None else source.encode("utf-8", "surrogatepass"))


def _keys(text: bytes, seed: int) -> list[tuple[int, int]]:
    """Of each line with a word: its key and its number of words."""
    out = []
    for line in text.translate(_FOLD).split(b"\n"):
        words = line.split()
        out.append((xxhash.xxh64_intdigest(b" ".join(words), seed) - (1 << 63), len(words)) if words else (0, 0))
    return out


def _line_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = as_bytes(batch.column("text"), lower=False)
        held: list[dict[int, int]] = []
        for text, source in zip(texts, batch.column("source").to_pylist()):
            own: dict[int, int] = {}
            for k, n in _keys(text, _seed(source)):
                if n:
                    own[k] = own.get(k, 0) + n
            held.append(own)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("source"),
                batch.column("digest"),
                pa.array([list(x) for x in held], pa.list_(pa.int64())),
                pa.array([list(x.values()) for x in held], pa.list_(pa.int64())),
            ],
            names=["source", "digest", "lines", "sizes"],
        )


def _depleted_pass(often, keep_share: float, min_words: int):
    """Of each text that loses too much with the lines in ``often``: those lines, and how many it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = often.value
        for batch in batches:
            at, found, words_of = [], [], []
            for i, (lines, sizes) in enumerate(zip(batch.column("lines").to_pylist(), batch.column("sizes").to_pylist())):
                words, gone = sum(sizes), sum(n for k, n in zip(lines, sizes) if k in own)
                if words >= min_words and words - gone < keep_share * words:
                    at.append(i)
                    found.append([k for k in lines if k in own])
                    words_of.append([n for k, n in zip(lines, sizes) if k in own])
            picked = batch.take(pa.array(at, pa.int32()))
            columns = [picked.column("source"), picked.column("digest"), pc.list_value_length(picked.column("lines")), pa.array(found, pa.list_(pa.int64())), pa.array(words_of, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["source", "digest", "whole", "lines", "sizes"])

    return run


def _depleted(seen: DataFrame, held: DataFrame, keep_share: float, min_words: int, max_broadcast: int) -> DataFrame:
    """``source, digest, whole, lines, sizes`` of texts that would keep less than ``keep_share`` without those ``lines``, the ones of ``held``; ``whole``: the number of all their lines."""
    found = held.select("line").limit(max_broadcast + 1).toArrow().column("line").to_pylist()
    if len(found) <= max_broadcast:
        own = seen.sparkSession.sparkContext.broadcast(frozenset(found))
        return seen.mapInArrow(_depleted_pass(own, keep_share, min_words), "source string, digest long, whole int, lines array<long>, sizes array<long>")
    words = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n)
    lines = seen.select("source", "digest", F.size("lines").alias("whole"), words.alias("words"), F.explode(F.arrays_zip("lines", "sizes")).alias("x")).where(F.col("words") >= min_words)
    lines = lines.select("source", "digest", "whole", "words", F.col("x.lines").alias("line"), F.col("x.sizes").alias("n")).join(held.select("line"), "line")
    texts = lines.groupBy("source", "digest", "whole", "words").agg(F.sum("n").alias("gone"), F.collect_list(F.struct("line", "n")).alias("x"))
    return texts.where(F.col("words") - F.col("gone") < keep_share * F.col("words")).select("source", "digest", "whole", F.col("x.line").alias("lines"), F.col("x.n").alias("sizes"))


def frequent_lines(docs: DataFrame, min_docs: int = 20, max_broadcast: int = 1 << 20, keep_share: float = 0.3, min_words: int = 50, copy_lines: int = 8) -> DataFrame:
    """``line``: keys (of host and line) of boilerplate lines."""
    text = docs.select(F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).where("text is not null").withColumn("digest", F.xxhash64("text"))
    seen = text.mapInArrow(_line_pass, "source string, digest long, lines array<long>, sizes array<long>").dropDuplicates(["source", "digest"])
    seen = cut_lineage(seen, "lines")
    # a line's key holds its host
    held = seen.select(F.explode("lines").alias("line")).groupBy("line").agg(F.count("*").alias("held")).where(F.col("held") > min_docs)
    held = cut_lineage(held, "held-lines")
    lost = cut_lineage(_depleted(seen, held, keep_share, min_words, max_broadcast), "depleted-texts")
    copied = (F.size("lines") >= copy_lines) & (3 * F.size("lines") > 2 * F.col("whole"))
    n, unlike = lost.agg(F.count("*"), F.count_if(~copied)).first()
    if not n:
        return held.select("line")
    longest = F.array_max(F.arrays_zip("sizes", "lines"))["lines"]
    groups = lost.where(copied).select("digest", "lines", longest.alias("one"))
    if unlike:
        rest = lost.where(~copied)
        keys = rest.select(F.col("source").alias("lost_source"), F.col("digest").alias("lost_digest"))
        same = (F.col("digest") == F.col("lost_digest")) & F.col("source").eqNullSafe(F.col("lost_source"))
        own = text.join(F.broadcast(keys) if unlike <= max_broadcast // 8 else keys, same, "left_semi").dropDuplicates(["digest"])
        near = ngram_jaccard_join(cut_lineage(own.select(F.col("digest").alias("doc_id"), "text"), "depleted-whole"))
        near = cut_lineage(near.select(F.col("doc_id").alias("digest"), F.col("component_id").alias("one")), "depleted-groups")
        groups = groups.unionByName(rest.join(near, "digest").select("digest", "lines", "one"))
    again = groups.select("one", F.explode("lines").alias("line")).groupBy("line", "one").agg(F.count("*").alias("n"))
    again = again.groupBy("line").agg((F.sum("n") - F.count("*")).alias("copies"))
    return held.join(again, "line", "left").where(F.col("held") - F.coalesce("copies", F.lit(0)) > min_docs).select("line")


def _judge(frequent, keep_share: float, with_text: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if frequent is None else frequent.value
        for batch in slices(batches, "__text"):
            texts = as_bytes(batch.column("__text"), lower=False)
            sources = batch.column("__source").to_pylist()
            told = base_rules(texts)
            listed = [own] * len(texts) if frequent is not None else [set(x or ()) for x in batch.column("__frequent").to_pylist()]
            kept, removed, clean = [], [], []
            for i, text in enumerate(texts):
                gone = 0
                if listed[i]:
                    keys = _keys(text, _seed(sources[i]))
                    gone = sum(n for k, n in keys if n and k in listed[i])
                removed.append(gone)
                kept.append(not told["base_failed"][i] and told["n_words"][i] - gone >= keep_share * told["n_words"][i])
                if with_text:
                    if gone:
                        lines = zip(text.split(b"\n"), keys)
                        text = b"\n".join([x for x, (k, n) in lines if not (n and k in listed[i])])
                    clean.append(text.decode("utf-8", "surrogatepass"))
            columns = [batch.column(x) for x in names]
            columns += [pa.array(told[x], pa.int64()) for x in _LONGS]
            columns += [pa.array(told["base_failed"]), pa.array(kept, pa.bool_()), pa.array(removed, pa.int64())]
            if with_text:
                columns.append(pa.array(clean, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])

    return run


def quality_rules(
    docs: DataFrame,
    min_docs: int = 20,
    keep_share: float = 0.3,
    columns: list[str] | None = None,
    with_text: bool = False,
    max_broadcast: int = 1 << 20,
) -> DataFrame:
    """``columns`` of each row (``doc_id`` if not given), the base counts,
    ``base_failed``, ``kept``, ``n_removed_words`` and, if asked for, ``clean_text``.

    Up to ``max_broadcast`` boilerplate lines (8 bytes each) are sent to the
    executors; more of them reach their documents by joins.
    """
    names = ["doc_id"] if columns is None else columns
    small_batches(docs)
    spark = docs.sparkSession
    often = cut_lineage(frequent_lines(docs, min_docs, max_broadcast, keep_share), "frequent-lines")
    inner = docs.select(*[F.col(x).alias(f"__c{i}") for i, x in enumerate(names)], F.col("text").cast("string").alias("__text"), F.col("source").cast("string").alias("__source"))
    found = often.limit(max_broadcast + 1).toArrow().column("line").to_pylist()
    if len(found) <= max_broadcast:
        frequent = spark.sparkContext.broadcast(frozenset(found))
    else:
        frequent = None
        inner = inner.withColumn("__row", F.xxhash64("__text", "__source"))
        lines = inner.select("__text", "__source", "__row").dropDuplicates(["__row"]).mapInArrow(_row_lines, "row long, line long")
        per = lines.join(often, "line").groupBy("row").agg(F.collect_set("line").alias("__frequent"))
        inner = inner.join(per, inner["__row"] == per["row"], "left").drop("row", "__row")
    fields = [T.StructField(f"o{i}", docs.schema[x].dataType) for i, x in enumerate(names)]
    fields += [T.StructField(x, T.LongType()) for x in _LONGS]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("n_removed_words", T.LongType())]
    fields += [T.StructField("clean_text", T.StringType())] if with_text else []
    plain = T.StructType([T.StructField(f"{i}", f.dataType) for i, f in enumerate(fields)])
    out = inner.mapInArrow(_judge(frequent, keep_share, with_text, [f"__c{i}" for i in range(len(names))]), plain)
    return out.toDF(*names, *[f.name for f in fields[len(names) :]])


def _row_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "__text"):
        row, line = [], []
        rows = zip(as_bytes(batch.column("__text"), lower=False), batch.column("__source").to_pylist(), batch.column("__row").to_pylist())
        for text, source, key in rows:
            own = {k for k, n in _keys(text, _seed(source)) if n}
            line += own
            row += [key] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(line, pa.int64())], names=["row", "line"])


def apply_quality_rules(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs`` for the documents that are kept, without their boilerplate lines."""
    names = [x for x in docs.columns if x not in ("text", "n_chars")]
    judged = quality_rules(docs, columns=names, with_text=True, **options).where("kept")
    text = F.col("clean_text")
    made = {"text": text, "n_chars": F.length(text)}
    return judged.select(*[made[x].cast(docs.schema[x].dataType).alias(x) if x in made else F.col(x) for x in docs.columns])
