"""Operator 1: n-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their sets of distinct
five-word shingles is at least ``percent``/100.  The join is exact:

1. *Counts.*  One pass gives each document's set size and a 128-bit digest of
   its set, and counts shingles over the whole corpus.  Counts are summed in
   every Arrow batch before they are dealt out, so a shingle that a third of
   all documents hold costs one entry a batch.  They leave two tables of bounded
   size: the ``max_heavy`` most frequent shingles, and a Bloom filter of
   shingles that occur more than once.
2. *Classes.*  Documents with equal digests are one class; its smallest doc_id
   represents it from here on.
3. *Prefixes.*  All shingles have one total order: those that aren't heavy by
   hash, then heavy ones by count.  Sets that link share at least ``l`` of
   their first ``n - ceil(0.8 n) + l`` shingles.  ``l`` is chosen for each
   document by the estimated cost of its candidates (see ``_lengthen``).  Of a
   pair with different ``l`` the lesser holds.  Shingles that only one document
   has can't match and aren't emitted; a document of which too many are its own
   has no links at all.
4. *Pivots.*  Each shingle's list has a pivot, the member in whose prefix it
   stands earliest.  Every document is verified against the pivot of most of
   its lists, and links are joined to components.
   A large group of near copies is so united by a number of pairs that grows
   with its size alone.
5. *The rest.*  Lists that still hold several components give all pairs of
   which the components differ and at most one is in the list's largest
   component, if sizes, positions and the number of shingles that others have
   allow 0.8 at all; pairs that share too few prefix
   shingles go, the others are verified.

Null texts and texts without words have empty sets and link with nothing.  A
null doc_id gives a row with null component_id and no links.  Rows that repeat
a doc_id share a component, which the links of any of their texts join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm._rows import without
from lumenframe.llm._text import as_bytes, distinct_sets, mix, shingles, slices, small_batches
from lumenframe.operators.components import connected_components
from lumenframe.storage import cut_lineage, drop

_PASS_1 = "doc_id long, n long, f1 long, f2 long, bucket int, tokens binary, counts binary"
_PASS_2 = "doc_id long, n long, reach long, ell int, toks array<long>, poss array<int>, members array<long>"
#: Shingles are counted by their upper bits; two that share them are counted as one, which can change only the order.
_COUNT_BITS = 40
_PROBES, _BITS_EACH = 4, 16
#: Bytes of input for each bucket of counts, which one Python worker holds.
_BUCKET_BYTES = 64 << 20
#: Least and most prefix shingles that a pair must share.
_MIN_ELL, _MAX_ELL = 3, 8
#: Up to so many ids of 8 bytes are sent to all executors, to pick the sets that verification needs.
_MAX_ENDS = 1 << 20
#: Cost of verifying a pair over that of listing it; what a pair could share at most leaves few to verify.
_VERIFY_COST = 1.0


def _sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return distinct_sets(*shingles(as_bytes(batch.column("text"))))


def _sums(op: np.ufunc, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at) - 1, dtype=np.uint64)
    full = np.diff(at) > 0
    if full.any():
        out[full] = op.reduceat(values, at[:-1][full])
    return out


def _bucket_start(k: int, buckets: int) -> int:
    """The least counted value of bucket k; with over 256 buckets the rest of a value takes 32 bits."""
    return -(-(k << _COUNT_BITS) // buckets)


def _count_pass(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat, at = _sets(batch)
            f1 = _sums(np.add, mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at).view(np.int64)
            f2 = _sums(np.bitwise_xor, mix(flat + np.uint64(0x1234567887654321)), at).view(np.int64)
            docs = batch.num_rows
            none = pa.nulls(docs, pa.binary())
            ids = batch.column("doc_id")
            # by id, set and place: copies of one text, rows of one id and batches of few rows are all dealt evenly
            lot = f1.view(np.uint64) + np.arange(docs, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            lot += ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            dealt = pa.array((mix(lot) % np.uint64(buckets)).astype(np.int32))
            yield _batch([ids, pa.array(np.diff(at)), pa.array(f1), pa.array(f2), dealt, none, none])
            value, count = np.unique(flat >> np.uint64(64 - _COUNT_BITS), return_counts=True)
            home = ((value * np.uint64(buckets)) >> np.uint64(_COUNT_BITS)).astype(np.int64)
            cut = np.searchsorted(home, np.arange(buckets + 1))
            rows = []
            for k in np.flatnonzero(np.diff(cut)).tolist():
                v, c = value[cut[k] : cut[k + 1]], count[cut[k] : cut[k + 1]]
                many = c > 1
                v, c = np.concatenate((v[many], v[~many])), c[many].astype(np.uint32)
                rows.append((k, (v - np.uint64(_bucket_start(k, buckets))).astype(np.uint32).tobytes(), c.tobytes()))
            n = len(rows)
            null = pa.nulls(n, pa.int64())
            yield _batch([null, null, null, null, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())])

    return run


def _batch(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "f1", "f2", "bucket", "tokens", "counts"])


def _input_bytes(docs: DataFrame) -> int:
    """The planner's estimate of the table's size; 0 where it has none."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


_COUNTED = "doc_id long, n long, f1 long, f2 long, slots binary, heavy binary, held binary"


def _slots(value: np.ndarray, width: np.ndarray | np.uint64) -> Iterator[np.ndarray]:
    """Places of shingles in their bucket's slice of the filter, by double hashing."""
    first = mix(value + np.uint64(0x5851F42D4C957F2D))
    step = (first >> np.uint64(32)) | np.uint64(1)
    for _ in range(_PROBES):
        yield (first % width).astype(np.int64)
        first = first + step


def _reduce(buckets: int, most_bits: int, min_heavy: int):
    """Sums a bucket's counts; gives its heavy shingles and its slice of the filter, and passes on the documents dealt to it."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        k = key[0].as_py()
        counts = pa.compute.is_valid(table.column("tokens"))
        docs = table.filter(pa.compute.invert(counts)).select(["doc_id", "n", "f1", "f2"])
        table = table.filter(counts)
        for name in ("slots", "heavy", "held"):
            docs = docs.append_column(name, pa.nulls(docs.num_rows, pa.binary()))
        if not table.num_rows:
            return docs
        parts, sums = [], []
        for t, c in zip(table.column("tokens").to_pylist(), table.column("counts").to_pylist()):
            parts.append(np.frombuffer(t, dtype=np.uint32).astype(np.uint64) + np.uint64(_bucket_start(k, buckets)))
            one = np.ones(len(parts[-1]), dtype=np.uint32)
            many = np.frombuffer(c, dtype=np.uint32)
            one[: len(many)] = many
            sums.append(one)
        value, count = np.concatenate(parts), np.concatenate(sums)
        order = np.argsort(value, kind="stable")
        value, count = value[order], count[order]
        first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
        value, count = value[first], np.add.reduceat(count.astype(np.int64), first)
        twice = value[count > 1]
        width = max(8, min(most_bits, max(64, _BITS_EACH * len(twice))) // 8 * 8)
        flags = np.zeros(width, dtype=bool)
        for slot in _slots(twice, np.uint64(width)):
            flags[slot] = True
        heavy = count >= min_heavy
        one = pa.nulls(1, pa.int64())
        found = pa.table([pa.array([k]), one, one, one, pa.array([np.packbits(flags).tobytes()], pa.binary()), pa.array([value[heavy].tobytes()], pa.binary()), pa.array([count[heavy].tobytes()], pa.binary())], names=docs.column_names)
        return pa.concat_tables([docs, found])

    return run


class ShingleOrder:
    """The total order of shingles, and which of them occur more than once."""

    def __init__(self, heavy: np.ndarray, counts: np.ndarray, slices: list[bytes]):
        self.heavy, self.counts = heavy, counts
        self.filter = np.frombuffer(b"".join(slices), dtype=np.uint8)
        self.width = np.array([8 * len(x) for x in slices], dtype=np.uint64)
        self.start = np.cumsum(self.width).astype(np.int64) - self.width.astype(np.int64)

    def count(self, flat: np.ndarray) -> np.ndarray:
        """Corpus count of heavy shingles, 0 for others."""
        if not len(self.heavy):
            return np.zeros(len(flat), dtype=np.int64)
        short = flat >> np.uint64(64 - _COUNT_BITS)
        at = np.minimum(np.searchsorted(self.heavy, short), len(self.heavy) - 1)
        return np.where(self.heavy[at] == short, self.counts[at], 0)

    def repeated(self, flat: np.ndarray) -> np.ndarray:
        """Whether the filter has them; it never misses one that occurs twice."""
        value = flat >> np.uint64(64 - _COUNT_BITS)
        bucket = ((value * np.uint64(len(self.width))) >> np.uint64(_COUNT_BITS)).astype(np.int64)
        start = self.start[bucket]
        found = np.ones(len(value), dtype=bool)
        for slot in _slots(value, self.width[bucket]):
            slot += start
            found &= (self.filter[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 > 0
        return found


def _lengthen(cost: np.ndarray, base: int) -> int:
    """The ``l`` of least estimated cost.

    ``cost`` has the counts of a document's shingles in order (light ones 0).
    Listing candidates costs the sum of counts over the prefix; by Markov's
    bound at most that sum divided by l partners share l of its shingles and
    must be verified.
    """
    ell = np.arange(_MIN_ELL, _MAX_ELL + 1)
    listed = np.cumsum(cost)[np.minimum(base - 2 + ell, len(cost) - 1)].astype(np.float64)
    return _MIN_ELL if listed[0] == 0 else int(ell[np.argmin(listed * (1 + _VERIFY_COST / ell))])


def _prefix_pass(order, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o: ShingleOrder = order.value
        for batch in slices(batches):
            flat, at = _sets(batch)
            count, twice = o.count(flat), o.repeated(flat)
            bounds = at.tolist()
            rows = []
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                a, b = bounds[i], bounds[i + 1]
                if a == b or doc is None:
                    continue
                n, reach = b - a, int(twice[a:b].sum())
                need = -(-percent * n // 100)
                if reach < need:  # what only this document has is shared with none
                    continue
                base = n - (-(-percent * n // 100)) + 1
                c, ranks = count[a:b], None
                if c.any():
                    ranks = np.argsort(c, kind="stable")  # sets are sorted by hash already
                    c = c[ranks]
                # no pair shares fewer than ceil(percent n) shingles, so that is the most it can be asked for
                ell = min(_lengthen(c, base), need)
                take = min(n, base + ell - 1)
                mine = flat[a:b] if ranks is None else flat[a:b][ranks]
                pos = np.flatnonzero(twice[a : a + take] if ranks is None else twice[a:b][ranks[:take]])
                if len(pos) >= min(_MIN_ELL, -(-percent * need // 100)):  # what its least partner may ask for
                    rows.append((doc, n, reach, ell, mine[pos].view(np.int64), pos.astype(np.int32), flat[a:b].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([r[3] for r in rows], pa.int32()),
                    pa.array([r[4] for r in rows], pa.list_(pa.int64())),
                    pa.array([r[5] for r in rows], pa.list_(pa.int32())),
                    pa.array([r[6] for r in rows], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "reach", "ell", "toks", "poss", "members"],
            )

    return run


def _verify(pairs: DataFrame, sets: DataFrame, percent: int, rows: int | None = None) -> DataFrame:
    """Of distinct (x, y), about ``rows``, those that link, written."""
    pairs = cut_lineage(pairs, "shingle-pairs", rows)
    n = pairs.count()
    ends = cut_lineage(pairs.select(F.explode(F.array("x", "y")).alias("cls")).distinct(), "shingle-ends", 2 * n)
    sets = sets.join(F.broadcast(ends) if ends.count() <= _MAX_ENDS else ends, "cls", "left_semi")
    left = sets.select(F.col("cls").alias("x"), F.col("members").alias("mx"))
    right = sets.select(F.col("cls").alias("y"), F.col("members").alias("my"))
    both = pairs.join(left, "x").join(right, "y")
    shared = F.size(F.array_intersect("mx", "my"))
    links = both.where(100 * shared >= percent * (F.size("mx") + F.size("my") - shared)).select("x", "y")
    links = cut_lineage(links, "shingle-links")
    drop(pairs, ends)
    return links


def link_classes(
    docs: DataFrame,
    percent: int = 80,
    min_heavy: int = 32,
    max_heavy: int = 1 << 20,
    filter_bits: int = 28,
) -> tuple[DataFrame, DataFrame]:
    """``(documents, links)`` of the join.

    documents: ``doc_id, n, cls`` (``cls``: the class's smallest doc_id, null
    for empty sets); links: ``id, component`` of the classes that are linked
    with other classes.

    ``max_heavy`` (entries of 16 bytes) and ``filter_bits`` (2**bits bits) bound
    the size of what is sent to each executor; past it the join stays exact and
    only lists more candidates.
    """
    spark = docs.sparkSession
    small_batches(docs)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = max(300, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_input_bytes(docs) // _BUCKET_BYTES))
    counted = text.mapInArrow(_count_pass(buckets), _PASS_1).groupBy("bucket").applyInArrow(_reduce(buckets, (1 << filter_bits) // buckets, min_heavy), _COUNTED)
    counted = cut_lineage(counted, "shingle-counts")
    parts = [b"\0"] * buckets
    values, counts = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for row in counted.where("slots is not null").select("doc_id", "slots", "heavy", "held").toLocalIterator():
        parts[row.doc_id] = bytes(row.slots)  # such a row has its bucket in place of a doc_id
        values.append(np.frombuffer(row.heavy, dtype=np.uint64))
        counts.append(np.frombuffer(row.held, dtype=np.int64))
        if sum(map(len, values)) > 2 * max_heavy:
            values, counts = _most(values, counts, max_heavy)
    (value,), (count,) = _most(values, counts, max_heavy)
    order = spark.sparkContext.broadcast(ShingleOrder(value, count, parts))

    every = counted.where("slots is null").select("doc_id", "n", "f1", "f2")
    same = ["n", "f1", "f2"]
    classes = every.where("n > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("cls"))
    classes = cut_lineage(classes, "shingle-classes", every.count())
    documents = cut_lineage(every.join(classes, same, "left").select("doc_id", "n", "cls"), "shingle-documents", every.count())
    documents, bridges = _bridged(documents)

    lists = cut_lineage(text.mapInArrow(_prefix_pass(order, percent), _PASS_2), "shingle-lists")
    listed, posted = lists.agg(F.count("*"), F.coalesce(F.sum(F.size("toks")), F.lit(0))).first()
    ours = lists.join(classes.select(F.col("cls").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = lists.select(F.col("doc_id").alias("cls"), "members")
    posts = ours.select(F.col("doc_id").alias("cls"), "n", "reach", "ell", F.arrays_zip("toks", "poss").alias("z")).select(
        "cls", "n", "reach", "ell", F.posexplode("z").alias("rb", "z")
    )
    posts = posts.select("cls", "n", "reach", "rb", "ell", F.col("z.toks").alias("tok"), F.col("z.poss").alias("pos"))
    early = F.least(F.col("pos").cast("long"), F.lit(1 << 20)) * (1 << 40) + F.xxhash64("cls").bitwiseAND(F.lit((1 << 40) - 1))
    stats = posts.groupBy("tok").agg(F.count("*").alias("held"), F.min_by("cls", early).alias("pivot")).where("held > 1")
    posts = cut_lineage(posts.join(stats.select("tok", "pivot"), "tok"), "shingle-posts", posted)

    sizes = classes.select(F.col("cls").alias("y"), F.col("n").alias("ny"))
    star = posts.where("cls <> pivot").groupBy(F.col("cls").alias("x"), F.col("pivot").alias("y")).agg(F.count("*").alias("votes"), F.max("n").alias("nx"))
    star = star.join(sizes, "y").where(f"100 * least(nx, ny) >= {percent} * greatest(nx, ny)")
    # the pivot of most of a document's lists; other links are left to step 5
    star = star.groupBy("x").agg(F.max_by("y", F.col("votes") * (1 << 40) + F.xxhash64("y").bitwiseAND(F.lit((1 << 40) - 1))).alias("y"))
    first = _verify(star, sets, percent, listed)
    joined = cut_lineage(connected_components(first, "x", "y", rows=listed), "shingle-parts", listed)

    rest = _remaining(posts, joined, percent)
    second = _verify(rest, sets, percent)
    links = cut_lineage(_merged(joined, second.union(bridges)), "shingle-links", listed)
    drop(lists, posts, joined, first, second)
    order.destroy()
    return documents, links


def _bridged(documents: DataFrame, most: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Documents whose rows all have a class if one of them has, and edges ``x, y`` between the classes of each doc_id.

    Only doc_ids with several classes, or with rows that have none, are looked up.
    """
    per = documents.where("doc_id is not null").groupBy("doc_id").agg(F.min("cls").alias("least"), F.max("cls").alias("most"), F.count("*").alias("rows"), F.count("cls").alias("classed"))
    mixed = cut_lineage(per.where("least <> most or (classed > 0 and classed < rows)").select("doc_id", "least"), "shingle-bridges")
    held = mixed.count()
    if not held:
        return documents, mixed.select(F.col("least").alias("x"), F.col("least").alias("y"))
    met = documents.join(F.broadcast(mixed) if held <= most else mixed, "doc_id", "left")
    edges = met.where("cls <> least").select(F.col("least").alias("x"), F.col("cls").alias("y")).distinct()
    return met.select("doc_id", "n", F.coalesce("cls", "least").alias("cls")), cut_lineage(edges, "shingle-bridge-edges")


def _merged(joined: DataFrame, more: DataFrame) -> DataFrame:
    """Components after further links, which are first brought to components: few if pivots have found most."""
    part = lambda side: joined.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
    over = more.join(part("x"), "x", "left").join(part("y"), "y", "left").select(F.coalesce("cx", "x").alias("a"), F.coalesce("cy", "y").alias("b"))
    again = connected_components(over, "a", "b", rows=more.count()).select(F.col("id").alias("part"), F.col("component").alias("least"))
    new = over.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("component"))
    all_ = joined.union(new.join(joined.select("id"), "id", "left_anti"))
    return all_.join(again, F.col("component") == F.col("part"), "left").select("id", F.coalesce("least", "component").alias("component"))


def _most(values: list[np.ndarray], counts: list[np.ndarray], limit: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    value, count = np.concatenate(values), np.concatenate(counts)
    if len(value) > limit:
        top = np.argpartition(-count, limit)[:limit]
        value, count = value[top], count[top]
    by = np.argsort(value)
    return [value[by]], [count[by]]


def _remaining(posts: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of different components that the pivots left.

    ``reach`` counts a document's shingles that others have, ``rb`` those of
    them before a list's own.  What two documents share is at most what both
    can share from there on and what both could before; of a pair's first l
    shared shingles, at most l - 1 come before.
    """
    now = posts.join(joined, posts.cls == joined.id, "left").select("tok", "cls", "n", "reach", "rb", "ell", F.coalesce("component", "cls").alias("part"))
    per = now.groupBy("tok", "part").agg(F.count("*").alias("held"), F.min("n").alias("least_n"))
    top = per.groupBy("tok").agg(F.max_by("part", F.col("held") * (1 << 20) + F.pmod(F.xxhash64("part"), F.lit(1 << 20))).alias("main"), F.count("*").alias("parts"), F.min("least_n").alias("least_n"))
    open_ = now.join(top.where("parts > 1").drop("parts"), "tok")
    # what stands so late that not even the list's smallest set could reach the similarity isn't compared
    able = open_.where(f"(reach - rb + least(rb, ell - 1)) * {100 + percent} >= {percent} * (n + least_n)")
    few = able.where("part <> main")
    a = few.select("tok", *[F.col(c).alias(f"{c}_a") for c in ("cls", "n", "reach", "rb", "ell", "part")])
    b = able.select("tok", *[F.col(c).alias(f"{c}_b") for c in ("cls", "n", "reach", "rb", "ell", "part", "main")])
    reach = f"(least(reach_a - rb_a, reach_b - rb_b) + least(rb_a, rb_b, ell_a - 1, ell_b - 1)) * {100 + percent} >= {percent} * (n_a + n_b)"
    alike = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    once = "part_b = main_b or cls_a < cls_b"
    pairs = a.join(b, "tok").where(f"part_a <> part_b and ({once}) and {alike} and {reach}")
    pairs = pairs.groupBy(F.least("cls_a", "cls_b").alias("x"), F.greatest("cls_a", "cls_b").alias("y")).agg(
        F.count("*").alias("shared"), F.min(F.least("ell_a", "ell_b")).alias("ell")
    )
    return pairs.where("shared >= ell").select("x", "y")


def ngram_jaccard_join(docs: DataFrame, percent: int = 80, **options) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``."""
    documents, links = link_classes(docs, percent, **options)
    out = documents.join(links, documents.cls == links.id, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "cls", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Documents without all but one, the smallest doc_id, of each component.

    Rows with the same doc_id are kept or dropped together; rows whose doc_id
    is null are kept.
    """
    found = ngram_jaccard_join(docs.select("doc_id", "text"), **options)
    return without(docs, found.where("component_id < doc_id"))
