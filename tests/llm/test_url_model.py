"""The trees of the url filter: features and statistics against plain Python, held-out urls."""

from __future__ import annotations

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import url_filter as U

PAGES = "/root/testdata/sf0.1/pages.parquet"


@pytest.fixture(scope="module")
def labelled(spark):
    parts = spark.read.parquet(PAGES).select("url", U.host_of(F.col("url")).alias("host"), U.path_of(F.col("url")).alias("path"))
    parts = parts.withColumn("rule", U.rule_of(F.col("host"), F.col("path"))).where("rule is not null")
    blocked = [rule for action, rule in U.RULES if action == "block"]
    return parts.select("url", "host", "path", F.col("rule").isin(blocked).cast("int").alias("label"))


def auc(y, score):
    order = sorted(zip(score, y))
    rank, total = {}, 0.0
    for i, (s, _) in enumerate(order):
        rank.setdefault(s, []).append(i + 1)
    total = sum(np.mean(rank[s]) for s, label in order if label)
    n = sum(y)
    return (total - n * (n + 1) / 2) / (n * (len(y) - n))


def test_held_out_urls(labelled):
    fold = F.crc32("url") % U.FOLDS
    model = U.train(labelled.where(fold != 0))
    held = U.with_features(labelled.where(fold == 0)).toArrow()
    y = held.column("label").to_pylist()
    assert len(y) > 150 and 0 < sum(y) < len(y)
    assert auc(y, model.score(held).tolist()) > 0.95


def test_verdicts_of_other_urls_differ(spark):
    rows = U.judge_urls(spark.read.parquet(PAGES)).where("rule is null").groupBy("verdict").count().collect()
    assert {r.verdict for r in rows} == {"allow", "block"}


def entropy(text):
    data = text.encode()
    return -sum(c / len(data) * math.log2(c / len(data)) for c in collections.Counter(data).values()) if data else 0.0


def share(text):
    return len(re.findall("[0-9]", text)) / len(text) if text else 0.0


def plain(url, host, path):
    url = url or ""
    query = re.match(r"(?s)[^?#]*\??([^#]*)", url)[1] if "?" in url.split("#")[0] else ""
    labels, parts = [x for x in host.split(".") if x], [x for x in path.split("/") if x]
    return [
        len(url), len(host), len(path), len(query), len(labels), len(parts), query.count("&") + 1 if query else 0, "#" in url,
        share(url), share(host), share(path), host.count("-"), path.count("-") + path.count("_"), max(map(len, labels), default=0),
        path.endswith("/"), bool(re.search(r"\.[^/]*/*$", path)), url.startswith("https"), host.startswith("www."), entropy(host), entropy(path),
    ]


def test_features_and_statistics(spark):
    urls = ["https://www.a-b.com/en/x_1.html?a=1&b#f", "http://h.org", "http://h.org/", "x", "", None, "http://é.de/ü/?", "ftp://1.2.3.4/p/q.txt/", "http://h.org/en/2", "http://g.org/en/2", "http://k.com/de/2"]
    rows = [(u, i % 2) for i, u in enumerate(urls)] * 2
    table = spark.createDataFrame(rows, "url string, label int").select("url", U.host_of(F.col("url")).alias("host"), U.path_of(F.col("url")).alias("path"), "label")
    model = U.train(table, max_train=0)
    data = U.with_features(table).toArrow()
    got = model.rows(data)
    found = data.to_pylist()
    for row, r in zip(got, found):
        assert np.allclose(row[:20], plain(r["url"], r["host"], r["path"])), r["url"]
        for k, slot in enumerate(r["slots"]):
            others = [x["label"] for x in found if x["url"] is not None and x["fold"] != r["fold"] for s in x["slots"] if s == slot]
            assert np.isclose(row[20 + k], (sum(others) + model.weight * model.prior) / (len(others) + model.weight))
    assert U.train(table.limit(0)).score(data).tolist() == [0.5] * len(found)
