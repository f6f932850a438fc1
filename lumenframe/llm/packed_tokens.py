"""Operator 3: token ids in bit-packed binary files.

Format of a shard (little-endian)::

    magic "LFPK" | version u32 | bits u32 | documents u64 | ids u64 | block u32
    doc_ids  documents x i64        null doc_ids as the least i64
    lengths  documents x u32
    blocks   ceil(ids / block) x u64  bit offset of each block in the payload
    payload  ids x ``bits`` bits, low bits first

Every id takes the least bits that hold the vocabulary, so id i of a block
starts at a known bit; numpy unpacks a block, or any run of ids inside it,
without reading what stands before.

Documents are dealt out by ranges of doc_id; each task writes shards of about
``shard_ids`` ids into a folder of files under way and moves each, when it is
whole, to a name of its partition, place and attempt that no other attempt has.
A manifest of one row per shard names the files of the attempts that counted
and orders them; files of an attempt that was lost or beaten aren't in it, so
readers leave them out.

A null text has only the end id.  Null doc_ids come first; rows with equal
doc_id are ordered by text.  An empty table gives no shards and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm._text import as_bytes, slices, small_batches
from lumenframe.llm._tokenizer import MEMO_WORDS, load
from lumenframe.storage import cut_lineage, new_path

MAGIC, VERSION, BLOCK = b"LFPK", 1, 4096
_HEAD = struct.Struct("<4sIIQQI")
_NULL = -(1 << 63)
#: Folder of files that are being written; Spark's readers skip names that start with an underscore.
_UNDER_WAY = "_under_way"


def bits_for(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` at ``bits`` bits each; a block of BLOCK ids always fills whole bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=bits)
    return np.packbits(flags.reshape(-1), bitorder="little").tobytes()


def unpack(payload: bytes | memoryview, bits: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from id ``first`` of a payload."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, dtype=f"<u{bits // 8}", count=count, offset=first * bits // 8).astype(np.uint32)
    start, end = first * bits, (first + count) * bits
    raw = np.frombuffer(payload, dtype=np.uint8)[start // 8 : -(-end // 8)]
    flags = np.unpackbits(raw, bitorder="little")[start % 8 : start % 8 + count * bits].reshape(-1, bits)
    wide = np.zeros((count, 32), dtype=np.uint8)
    wide[:, :bits] = flags
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


def shard_bytes(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    blocks = np.arange(-(-len(ids) // BLOCK), dtype="<u8") * np.uint64(BLOCK * bits)
    head = _HEAD.pack(MAGIC, VERSION, bits, len(doc_ids), len(ids), BLOCK)
    return b"".join([head, doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), blocks.tobytes(), pack(ids, bits)])


class Shard:
    """A shard's bytes, opened for random access."""

    def __init__(self, data: bytes):
        magic, version, self.bits, docs, self.n_ids, self.block = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a packed token shard")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(data, dtype="<i8", count=docs, offset=at)
        self.lengths = np.frombuffer(data, dtype="<u4", count=docs, offset=at + 8 * docs).astype(np.int64)
        blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, dtype="<u8", count=blocks, offset=at + 12 * docs)
        self.payload = memoryview(data)[at + 12 * docs + 8 * blocks :]
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))

    def ids(self, first: int, count: int) -> np.ndarray:
        """Any run of ids; only its blocks are unpacked."""
        if not count:
            return np.zeros(0, dtype=np.uint32)
        block = first // self.block
        from_ = int(self.offsets[block]) // 8
        return unpack(self.payload[from_:], self.bits, first - block * self.block, count)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.lengths[i]))


def _file(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _write_pass(root: str, vocabulary: str, end_id: int, shard_ids: int, memo_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(vocabulary)
        encoder.limit = memo_words
        width = encoder.width
        bits = bits_for(encoder.vocab_size)
        end = np.array([end_id], dtype=encoder.kind).tobytes()
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        store, folder = _file(root)
        docs: list[np.ndarray] = []
        lengths: list[int] = []
        raw: list[bytes] = []
        held, made = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, made
            ids = np.frombuffer(b"".join(raw), dtype=encoder.kind)
            data = shard_bytes(np.concatenate(docs), np.array(lengths), ids, bits)
            name = f"part-{part:06d}-{made:06d}-{attempt}.lfpk"
            with store.open_output_stream(f"{folder}/{_UNDER_WAY}/{name}") as out:
                out.write(data)
            store.move(f"{folder}/{_UNDER_WAY}/{name}", f"{folder}/{name}")
            row = pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([made]), pa.array([name]), pa.array([len(lengths)]), pa.array([len(ids)])], names=["part", "shard", "name", "n_docs", "n_ids"]
            )
            docs.clear(), lengths.clear(), raw.clear()
            held, made = 0, made + 1
            return row

        for batch in slices(batches):
            doc = np.array([_NULL if x is None else x for x in batch.column("doc_id").to_pylist()], dtype=np.int64)
            for i, ids in enumerate(encoder.encode(as_bytes(batch.column("text"), lower=False))):
                docs.append(doc[i : i + 1])
                raw.append(ids)
                raw.append(end)
                lengths.append(len(ids) // width + 1)
                held += lengths[-1]
                if held >= shard_ids:
                    yield flush()
        if lengths:
            yield flush()

    return run


def write_tokens(docs: DataFrame, root: str, vocabulary: str, end_id: int = 2, shard_ids: int = 1 << 21, memo_words: int = MEMO_WORDS) -> DataFrame:
    """Write shards below ``root`` in ascending doc_id order; returns the manifest ``name, n_docs, n_ids, start``."""
    small_batches(docs)
    store, folder = _file(root)
    store.create_dir(f"{folder}/{_UNDER_WAY}")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.md5(F.coalesce("text", F.lit("")))]
    # ranges of (doc_id, digest): a doc_id that many rows share is dealt over several tasks
    dealt = text.withColumn("tie", order[1]).repartitionByRange(order[0], F.col("tie"))
    dealt = dealt.sortWithinPartitions(order[0], "tie").select("doc_id", "text")
    schema = "part long, shard long, name string, n_docs long, n_ids long"
    found = cut_lineage(dealt.mapInArrow(_write_pass(root, vocabulary, end_id, shard_ids, memo_words), schema), "token-manifest")
    store.delete_dir(f"{folder}/{_UNDER_WAY}")
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    return cut_lineage(found.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "token-manifest").select("name", "n_docs", "n_ids", "start")


def _read_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
            shard = Shard(data)
            ids = shard.ids(0, shard.n_ids).astype("<u4").tobytes()
            starts = shard.starts.tolist()
            view = memoryview(ids)
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts, starts[1:])]
            doc = pa.array(shard.doc_ids, mask=shard.doc_ids == _NULL)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(crc), pa.string()), doc, pa.array(shard.starts[:-1]), pa.array(shard.lengths), pa.array(crc, pa.int64())],
                names=["name", "doc_id", "within", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.lfpk").load(root)
    files = files.select(F.substring_index("path", "/", -1).alias("name"), "content")
    found = files.mapInArrow(_read_pass, "name string, doc_id long, within long, n_tokens long, ids_crc32 long")
    joined = found.join(manifest.select("name", F.col("start").alias("base")), "name")
    return joined.select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_file_digest(docs: DataFrame, vocabulary: str, end_id: int = 2, **options) -> DataFrame:
    """Write ``docs`` to a new folder of the shared place and read the files back."""
    root = new_path(docs.sparkSession, "tokens")
    return read_tokens(docs.sparkSession, root, write_tokens(docs, root, vocabulary, end_id, **options))
