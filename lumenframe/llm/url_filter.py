"""Operator 5: URL filters by rules and gradient-boosted trees on lexical features.

Host and path come from the url by SQL functions; the longest rule that fits
gives the verdict.  The trees judge the urls that no rule fits: they see only
lengths, depth, shares of digits, entropies, parameter counts and statistics of
suffixes (a host's last label and last two labels, a path's first part and its
extension), and learn from labelled urls, by default those that rules judge, of
which the ``max_train`` with the least hash are the documented sample.  A url is
blocked if its score is over ``threshold``.

A suffix's statistic is the smoothed share of blocked urls among *all* labelled
urls that have it.  Suffixes are hashed to SLOTS places, so the table has a
fixed size however many suffixes there are; those that meet in one place share
it.  Urls are dealt to FOLDS by their hash, and a url only ever sees the counts
of the other folds: the trees train on statistics that don't hold the row's own
label.

Null urls and urls without ``://`` have empty host and path; they are scored
like others.  Without labels, or with labels of one kind only, the score is
constant: the smoothed share of blocked ones.  A url with labels of both kinds
counts as blocked in the sample.
Rows that repeat get the same verdict; extra columns have no effect.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm._gbt import Trees, fit
from lumenframe.llm._stats import byte_entropy, histogram
from lumenframe.llm._text import as_bytes

FOLDS = 5
SLOTS = 1 << 16

RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits; of equally long ones the first listed. Null if none does."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: -len(r[1]))[::-1]:
        at = rule.index("/")
        own, start = rule[:at], rule[at:]
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _share(text: Column, kind: str) -> Column:
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(kind)) / F.length(text)).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> Column:
    """Features of a url, entropies and suffixes apart, as one array."""
    url = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    longest = F.coalesce(F.array_max(F.transform(labels, F.length)), F.lit(0))
    made = [
        F.length(url), F.length(host), F.length(path), F.length(query), F.size(labels), F.size(parts),
        F.when(query != "", F.regexp_count(query, F.lit("&")) + 1).otherwise(0), F.contains(url, F.lit("#")),
        _share(url, "[0-9]"), _share(host, "[0-9]"), _share(path, "[0-9]"), F.regexp_count(host, F.lit("-")), F.regexp_count(path, F.lit("[-_]")),
        longest, F.endswith(path, F.lit("/")), F.regexp_like(path, F.lit(r"\.[^/]*/*$")), F.startswith(url, F.lit("https")), F.startswith(host, F.lit("www.")),
    ]
    return F.array(*[x.cast("double") for x in made])


def suffix_slots(host: Column, path: Column) -> Column:
    """Places of a url's four suffixes in the table of statistics."""
    made = [
        F.substring_index(host, ".", -1),
        F.substring_index(host, ".", -2),
        F.regexp_extract(path, "^/([^/]*)", 1),
        F.regexp_extract(path, r"\.([^./]*)/*$", 1),
    ]
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), x), F.lit(SLOTS)).cast("int") for i, x in enumerate(made)])


def with_features(urls: DataFrame) -> DataFrame:
    """``url, host, path`` and others with ``x, slots, fold``."""
    host, path = F.col("host"), F.col("path")
    fold = F.coalesce(F.crc32("url") % FOLDS, F.lit(0)).cast("int")
    return urls.withColumns({"x": lexical(F.col("url"), host, path), "slots": suffix_slots(host, path), "fold": fold})


def _flat(column, kind: type) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).astype(kind).reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


@dataclass
class UrlModel:
    trees: Trees
    blocked: np.ndarray  # FOLDS x SLOTS
    seen: np.ndarray
    prior: float
    weight: float = 2.0

    def rows(self, data) -> np.ndarray:
        """Feature rows of a table or batch with ``host, path, x, slots, fold``."""
        slots, fold = _flat(data.column("slots"), np.int64), np.asarray(data.column("fold")).astype(np.int64)[:, None]
        blocked = self.blocked.sum(axis=0)[slots] - self.blocked[fold, slots]
        seen = self.seen.sum(axis=0)[slots] - self.seen[fold, slots]
        entropy = [byte_entropy(histogram(as_bytes(data.column(c), lower=False)))[:, None] for c in ("host", "path")]
        return np.hstack([_flat(data.column("x"), np.float64), *entropy, (blocked + self.weight * self.prior) / (seen + self.weight)])

    def score(self, data) -> np.ndarray:
        return self.trees.score(self.rows(data)) if data.num_rows else np.zeros(0)


def train(labelled: DataFrame, max_train: int = 20_000, **options) -> UrlModel:
    """Fit on ``url, host, path, label`` (1: block): statistics of all, trees of at most ``max_train`` distinct urls by least hash."""
    rows = with_features(labelled.where("label is not null and url is not null"))
    counts = rows.select("fold", "label", F.explode("slots").alias("slot")).groupBy("fold", "slot").agg(F.sum("label").alias("blocked"), F.count("*").alias("seen"))
    counts = counts.toArrow()  # at most FOLDS x SLOTS rows
    at = (np.asarray(counts.column("fold")).astype(np.int64), np.asarray(counts.column("slot")).astype(np.int64))
    blocked, seen = np.zeros((FOLDS, SLOTS)), np.zeros((FOLDS, SLOTS))
    blocked[at], seen[at] = np.asarray(counts.column("blocked")), np.asarray(counts.column("seen"))
    some = rows.groupBy("url", "host", "path", "x", "slots", "fold").agg(F.max("label").alias("label"))
    some = some.orderBy(F.xxhash64("url"), "url").limit(max_train).toArrow()
    y = np.asarray(some.column("label")).astype(np.float64)
    model = UrlModel(fit(np.zeros((0, 1)), np.zeros(0)), blocked, seen, float((y.sum() + 1) / (len(y) + 2)))
    if len(y):
        model.trees = fit(model.rows(some), y, **options)
    return model


def _judge_pass(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.value.score(batch)
            made = pa.array(np.where(score > threshold, "block", "allow").tolist(), pa.string())
            verdict = pa.compute.coalesce(batch.column("told"), made)
            columns = [batch.column(c) for c in ("page_id", "host", "path", "rule")]
            yield pa.RecordBatch.from_arrays([*columns, verdict, pa.array(score, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "score"])

    return run


def judge_urls(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, threshold: float = 0.5, **options) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of each row."""
    url = F.col("url").cast("string")
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    parts = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    told = F.lit(None).cast("string")
    for action, rule in rules:
        told = F.when(F.col("rule") == rule, F.lit(action)).otherwise(told)
    parts = parts.withColumn("told", told)
    if labelled is None:
        labelled = parts.where("told is not null").select("url", "host", "path", (F.col("told") == "block").cast("int").alias("label"))
    else:
        url = F.col("url").cast("string")
        labelled = labelled.select(url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), F.col("label").cast("int").alias("label"))
    model = pages.sparkSession.sparkContext.broadcast(train(labelled, **options))
    schema = "page_id long, host string, path string, rule string, verdict string, score double"
    return with_features(parts).mapInArrow(_judge_pass(model, threshold), schema)
