"""Spelling variants against brute force."""

from __future__ import annotations

import collections
import random
import re
import zlib

import pytest

from lumenframe.llm import spelling as S

DOCS = "doc_id long, text string, word string, n int"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least_length=7, least_count=2, times=10):
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least_length and k >= least_count}
    near = {w: [x for x in n if abs(len(x) - len(w)) <= 1 and x != w and one_edit(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= times * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], DOCS)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in S.spelling_variants(df, **options).collect()}


def edited(rng, word, letters):
    i = rng.randrange(len(word) + 1)
    kind = rng.randrange(3)
    if kind == 0:
        return word[:i] + rng.choice(letters) + word[i:]
    return word[:i] + (rng.choice(letters) if kind == 1 else "") + word[i + 1 :]


@pytest.mark.parametrize("most", [1, 3, 64])
def test_variants_are_brute_forces(spark, most):
    rng = random.Random(most)
    letters = "abcàÿÞ"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 14))) for _ in range(12)]
    words = stems + [edited(rng, w, letters) for w in stems for _ in range(8)]
    words += [edited(rng, w, letters) for w in words]
    # many words that begin alike, and many that end alike
    words += ["gemeinsam" + "".join(rng.choice("ab") for _ in range(4)) for _ in range(30)] + ["".join(rng.choice("ab") for _ in range(5)) + "haltung" for _ in range(30)]
    rows = []
    for i in range(300):
        some = [w if rng.random() < 0.8 else w.upper() for w in rng.choices(words, k=20)] + rng.choices(stems, k=25)
        rows.append((i, rng.choice([" ", "1", "\n", "-"]).join(some)))
    want = brute(rows)
    got = found(spark, rows, most=most, shard_rows=400)
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 20 and max(v[3] for v in want.values()) > 5


@pytest.mark.parametrize("max_broadcast", [0, 1 << 20])
def test_shared_segments_in_both_ways(spark, max_broadcast):
    words = ["abcdefg" + a + b + c for a in "hijk" for b in "lmno" for c in "pqrs"] + [a + b + "cdefghijk" for a in "lmnop" for b in "qrstu"]
    rows = [(i, " ".join(words)) for i in range(2, 4)]
    assert found(spark, rows, most=2, max_broadcast=max_broadcast) == brute(rows)


def test_chains_of_forms(spark):
    # each a tenth of the next: the root is the last of them
    chain = [("rootwords", 3000), ("rootword", 290), ("rootwird", 28), ("rotwird", 2)]
    rows = [(None, " ".join([w] * n)) for w, n in chain]
    want = brute(rows)
    got = found(spark, rows)
    assert got == want
    assert {r for _, r, *_ in want.values()} == {"rootwords"} and len(want) == 4


def test_ties_go_to_the_least_word(spark):
    rows = [(i, "abcdefgx " * 20 + "abcdefga " * 20 + "abcdefgé " * 20 + "abcdefg " * 2) for i in (1, 2)]
    got = found(spark, rows)
    assert got == brute(rows) and got["abcdefg"][0] == "abcdefga" and got["abcdefg"][3] == 3


def test_odd_rows(spark):
    long = "q" * 40_000
    rows = [(1, None), (2, ""), (3, "123 456"), (None, "Wörterbuch wörterbuch"), (None, "Wörterbuch wörterbuch"), (4, f"{long} {long} {long}x {long}x"), (4, f"{long} {long} {long}x {long}x"), (5, "short words only are not any")]
    got = found(spark, rows)
    assert got == brute(rows) and len(got) >= 3
    assert found(spark, []) == {} and found(spark, [(1, None)]) == {}


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in S.spelling_variants(df).collect()}
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])
