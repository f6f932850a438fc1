"""Identifiers of another shape than the seeds, found by their words before and after."""

from __future__ import annotations

import random

from lumenframe.llm.pii import find_pii


def words(rng, n):
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(n))


def spans(text, kind, value):
    return f"{kind}:{text.index(value)}:{text.index(value) + len(value)}"


def test_context_finds_other_shapes(spark):
    rng = random.Random(8)
    rows = [(i, f"{words(rng, 4)} phone: +1-{200 + i}-555-{1000 + i} {words(rng, 3)}") for i in range(60)]
    rows += [(100 + i, f"{words(rng, 4)} {4000 + i}.7.7@x.example.com is my mailbox") for i in range(60)]
    told = {
        300: ("phone", "555-123-4567", "phone: 555-123-4567 until noon"),
        301: ("phone", "(555) 123 4567", "é phone: (555) 123 4567 until noon"),
        302: ("phone", "555 123 4567", "phone: 555 123 4567, or later"),
        303: ("phone", "555-123-4567", "phone: 555-123-4567 20 times"),
        304: ("email", "jo@büro.example", "write jo@büro.example is one"),
    }
    rows += [(d, text) for d, (_, _, text) in told.items()]
    rows += [(400, "order 555-123-4567 came late"), (401, "phone: 12 or 1234567 times"), (402, "phone: none")]
    got = {r.doc_id: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, (kind, value, text) in told.items():
        assert (d, got[d].n_added, got[d].spans) == (d, 1, spans(text, kind, value))
    assert all(got[d].n_added == 0 for d in (400, 401, 402, *range(60), *range(100, 160)))
