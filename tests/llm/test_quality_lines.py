"""Boilerplate lines of a large host."""

from __future__ import annotations

import collections
import random
import re

import pytest

from lumenframe.llm.quality_rules import apply_quality_rules, quality_rules
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(n))


def run(spark, rows, **options):
    return {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, DOCS), **options).collect()}


@pytest.mark.parametrize("max_broadcast", [1000, 1])
def test_lines_of_a_large_host(spark, max_broadcast):
    rng = random.Random(3)
    menu, passage, rare = sentence(rng, 12), sentence(rng, 120), sentence(rng, 15)
    rows = []
    for i in range(3000):
        lines = [sentence(rng, 45), sentence(rng, 45)]
        lines = [menu, *lines] if i < 40 else [*lines, passage] if i < 100 else [*lines, rare] if i < 120 else lines
        rows.append((i, "\n".join(lines), "en", "host", 0))
    base = [sentence(rng, 12) for _ in range(10)]
    for i in range(400):
        lines = list(base)
        lines[i % 10] = sentence(rng, 12)
        rows.append((5000 + i, "\n".join(lines), "en", "host", 0))
    got = run(spark, rows, max_broadcast=max_broadcast)
    assert {got[i].n_removed_words for i in range(40)} == {12}
    assert {got[i].n_removed_words for i in range(40, 100)} == {120}
    assert {got[i].n_removed_words for i in range(100, 3000)} == {0}  # 20 documents are not more than 20
    assert all(got[i].n_removed_words == 0 and got[i].kept for i in range(5000, 5400))


@pytest.mark.parametrize("shared", [[120], [40, 40, 40], [20] * 6])
def test_depleted_documents_are_rejected(spark, shared):
    """A passage, or a template of several lines, beside few words of the document's own."""
    rng = random.Random(5)
    template = [sentence(rng, n) for n in shared]
    rows = [(i, "\n".join([*template, sentence(rng, 20)]), "en", "host", 0) for i in range(1000)]
    rows += [(2000 + i, sentence(rng, 140), "en", "host", 0) for i in range(50)]
    got = run(spark, rows)
    assert all(got[i].n_removed_words == 120 and not got[i].kept and not got[i].base_failed for i in range(1000))
    assert all(got[i].n_removed_words == 0 and got[i].kept for i in range(2000, 2050))


@pytest.mark.parametrize("size", [50, 380, 420, 2000])
def test_one_limit_for_hosts_of_every_size(spark, size):
    rng = random.Random(size)
    often, rare = sentence(rng, 15), sentence(rng, 15)
    rows = []
    for i in range(size):
        lines = [sentence(rng, 60)] + ([often] if i < 21 else []) + ([rare] if i < 20 else [])
        rows.append((i, "\n".join(lines), "en", "host", 0))
    got = run(spark, rows)
    assert {got[i].n_removed_words for i in range(21)} == {15} and {got[i].n_removed_words for i in range(21, size)} == {0}


def test_near_copies_stay_beside_a_template(spark):
    """Lines of near copies stay; the same host's menu goes, also from the copies."""
    rng = random.Random(6)
    menu, base = sentence(rng, 10), [sentence(rng, 30) for _ in range(12)]
    rows = []
    for i in range(200):
        lines = list(base)
        for _ in range(2):
            at = rng.randrange(12)
            words = lines[at].split()
            words[rng.randrange(30)] = sentence(rng, 1)
            lines[at] = " ".join(words)
        rows.append((i, "\n".join([menu, *lines]), "en", "host", 0))
    rows += [(1000 + i, "\n".join([menu, sentence(rng, 90)]), "en", "host", 0) for i in range(60)]
    got = run(spark, rows)
    assert all(r.kept and r.n_removed_words == 10 for r in got.values())


def brute_verdicts(rows, min_docs, keep_share):
    """doc_id -> (removed words, kept), by the definition."""

    def lines_of(text):
        return [" ".join(re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), x)).split()) for x in (text or "").split("\n")]

    size = lambda lines: sum(len(x.split()) for x in lines)
    counted = collections.defaultdict(set)
    for _, text, _, host, _ in rows:
        for line in filter(None, lines_of(text)):
            counted[host, line].add(text)
    group, lost = {}, []
    for text, host in {(r[1] or "", r[3]) for r in rows}:
        lines = [x for x in lines_of(text) if x]
        gone = [x for x in lines if len(counted[host, x]) > min_docs]
        if size(lines) >= 50 and size(lines) - size(gone) < keep_share * size(lines):
            if len(set(gone)) >= 8 and 3 * len(set(gone)) > 2 * len(set(lines)):
                group[host, text] = "lines", max(set(gone), key=lambda x: gone.count(x) * len(x.split()))
            else:
                lost.append((host, text))
    near = brute.components([(i, t) for i, (_, t) in enumerate(lost)])
    group |= {key: ("texts", near[i][1]) for i, key in enumerate(lost)}
    often = {k for k, texts in counted.items() if len({group.get((k[0], t), ("text", t)) for t in texts}) > min_docs}
    out = {}
    for doc, text, _, host, _ in rows:
        n, *_, failed = brute.base_rules(text)
        gone = size(x for x in lines_of(text) if (host, x) in often)
        out[doc] = (gone, not failed and n - gone >= keep_share * n)
    return out


@pytest.mark.parametrize("max_broadcast", [1000, 1])
def test_verdicts_are_the_definitions(spark, max_broadcast):
    rng = random.Random(14)
    menus = [sentence(rng, rng.randrange(3, 30)) for _ in range(12)]
    rows = []
    for i in range(400):
        lines = [sentence(rng, rng.randrange(5, 50)) for _ in range(rng.randrange(4))]
        lines += rng.choices(menus, k=rng.randrange(8))
        rng.shuffle(lines)
        rows.append((i, "\n".join(x.upper() if rng.random() < 0.2 else x for x in lines), "en", rng.choice(["a", "b", None]), 0))
    # lines of lengths of their own, so that a longest one is never a tie
    base, few = [sentence(rng, 6 + k) for k in range(12)], [sentence(rng, 30) for k in range(4)]
    for i in range(60):
        lines = list(base)
        lines[rng.randrange(12)] = sentence(rng, 3)
        rows.append((2000 + i, "\n".join(lines), "en", "a", 0))
        lines = list(few)
        lines[i % 4] += " " + sentence(rng, 1)
        rows.append((3000 + i, "\n".join(lines), "en", "b", 0))
    rows += [(1000 + i, rows[i][1], "en", rows[i][3], 0) for i in range(40)]
    got = {d: (r.n_removed_words, r.kept) for d, r in run(spark, rows, min_docs=15, max_broadcast=max_broadcast).items()}
    want = brute_verdicts(rows, 15, 0.3)
    assert got == want and len({x for x, _ in want.values()}) > 10
    failed = {r[0] for r in rows if brute.base_rules(r[1])[-1]}
    assert any(not kept and d not in failed for d, (_, kept) in want.items()) and all(want[k + i][1] for i in range(60) for k in (2000, 3000))


def test_verdicts_on_the_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = {r.doc_id: (r.n_removed_words, r.kept) for r in quality_rules(spark.createDataFrame(docs)).collect()}
    assert got == brute_verdicts([tuple(r) for r in docs], 20, 0.3)


def test_length_column_keeps_its_type(spark):
    rng = random.Random(15)
    df = spark.createDataFrame([(1, sentence(rng, 80), "en", "h", 5)], "doc_id long, text string, lang string, source string, n_chars int")
    assert apply_quality_rules(df).schema == df.schema
