"""Every operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenframe.llm import _gbt, _stats
from lumenframe.llm._tokenizer import load
from lumenframe.llm.decontaminate import contained_items, decontaminate
from lumenframe.llm.ngram_join import keep_one, ngram_jaccard_join
from lumenframe.llm.packed_tokens import Shard, bits_for, pack, read_tokens, shard_bytes, token_file_digest, unpack, write_tokens
from lumenframe.llm.page_text import deleted_lines, main_text, page_lines, shared_lines
from lumenframe.llm.pii import find_pii
from lumenframe.llm.quality_classifier import classify
from lumenframe.llm.quality_rules import apply_quality_rules, quality_rules
from lumenframe.llm.source_mix import mix_sources, mixed_documents
from lumenframe.llm.token_counts import encode_long, token_counts
from lumenframe.llm.url_filter import judge_urls
from tests.llm import brute

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "n int, cls int, id int, size int, copies int, label int, row int, place int, bucket int, digest int, host int, path int, gone int, told int, k int, v int, spans int, tie int"


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]) + str(rng.randrange(300)) for _ in range(n))


def nasty(spark, extra=False):
    """Nulls, empty and wordless texts, one very long text, ties, repeated rows, odd characters."""
    rng = random.Random(5)
    base = sentence(rng, 120)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", " \n\t ", "Word", "a b c", base, base, " ".join(near), base.upper(), sentence(rng, 9000), "é😀 <|endoftext|> x\x1cy İ ΣΑΣ don't",
             "mail a.b@c.de ip 1.2.3.4 card 4035787455641871 phone +1 (640) 555-0953 " + sentence(rng, 60), ("same three words " * 40).strip(), "x" * 50000, sentence(rng, 80) + "\n\n" + sentence(rng, 5)]
    rows = [(i, t, "en", None if i % 4 == 0 else f"s{i % 3}", None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for field in CLASHES.split(", "):
            df = df.withColumn(field.split()[0], F.lit(1))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


# 1


def test_join_is_exact(docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(docs).collect()}
    assert got == brute.components(texts)


@pytest.mark.parametrize("options", [{}, {"min_heavy": 2, "max_heavy": 3, "filter_bits": 6}])
def test_join_of_large_near_copy_group(spark, options):
    rng = random.Random(1)
    base = sentence(rng, 150).split()
    shared = sentence(rng, 30)
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    rows += [(i, f"{shared} {sentence(rng, rng.randrange(1, 60))}") for i in range(150, 260)]
    rows += [(i, " ".join(f"w{j}" for j in range(i % 7))) for i in range(260, 290)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()}
    assert got == brute.components(rows)


def test_join_edges(spark):
    rows = ngram_jaccard_join(nasty(spark, extra=True)).collect()
    assert len(rows) == 19
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None}
    want = brute.components({r.doc_id: r.text for r in nasty(spark).collect() if r.doc_id is not None}.items())
    assert got == want and got[5] == got[6] == got[8]
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert ngram_jaccard_join(empty(spark)).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    rng = random.Random(11)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    rows = [(3, a), (5, a), (1, b), (5, b), (7, c), (7, None), (9, c), (9, ""), (4, None), (4, " ")]
    got = {}
    for r in ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.component_id)
    assert got == {1: {1}, 3: {1}, 5: {1}, 7: {7}, 9: {7}, 4: {4}}


def test_keep_one(spark):
    kept = [r.doc_id for r in keep_one(nasty(spark, extra=True)).collect()]
    assert kept.count(5) == 3 and 6 not in kept and 7 not in kept and 8 not in kept and kept.count(None) == 2


# 2 and 3


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_counts_are_the_librarys(spark, docs, tokenizer):
    for df in (docs, nasty(spark, extra=True)):
        source = sorted((r.doc_id or -1, len((r.text or "").encode()), len(ids(tokenizer, r.text))) for r in df.collect())
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in token_counts(df, VOCABULARY, chunk_chars=900, overlap=8).collect()) == source
    assert all(r.over_limit == (r.n_tokens > 2048) for r in token_counts(nasty(spark), VOCABULARY).collect())
    assert token_counts(empty(spark), VOCABULARY).count() == 0


@pytest.mark.parametrize("overlap", [1, 7, 64])
def test_resynchronisation(texts, tokenizer, overlap):
    encoder = load(VOCABULARY)
    samples = ["\n".join(t for _, t in texts[:20]), "a" * 3000 + " b" * 9 + "x" * 900, "no_space" * 900, " " * 2000 + "end", "<|endoftext|> é 'll " * 300, ""]
    for text in samples:
        assert encode_long(encoder, text, 500, overlap).tolist() == ids(tokenizer, text)


def test_words_are_encoded_as_the_library_does(tokenizer):
    encoder = load(VOCABULARY)
    rng = random.Random(3)
    marks = list("abcDEF'.,-_<|>é£😀\u0301\u0345\x1c\x85\u2028 12") + ["<|endoftext|>", "'s", "'LL", "İ", "ß", "\ufb01", "\u1e9e", "K"]
    for _ in range(400):
        text = "".join(rng.choice(marks) for _ in range(rng.randrange(30)))
        assert np.frombuffer(encoder.encode([text.encode()])[0], dtype=encoder.kind).tolist() == ids(tokenizer, text), repr(text)


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31])
def test_packing_round_trip(bits):
    a = np.random.default_rng(bits).integers(0, 1 << bits, 9001)
    assert (unpack(pack(a, bits), bits, 0, 9001) == a).all()
    shard = Shard(shard_bytes(np.array([1, 2]), np.array([4000, 5001]), a, bits))
    assert (shard.ids(4097, 77) == a[4097:4174]).all() and (shard.document(1) == a[4000:]).all()
    assert bits_for(1 << bits) == bits and bits_for((1 << bits) + 1) == bits + 1


def test_token_files(spark, docs, tokenizer, tmp_path):
    manifest = write_tokens(docs, f"file://{tmp_path}/out", VOCABULARY, shard_ids=5000)
    assert manifest.count() > 3 and len(list((tmp_path / "out").glob("*.lfpk"))) == manifest.count()
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in read_tokens(spark, f"file://{tmp_path}/out", manifest).collect()}
    start = 0
    for r in sorted(docs.collect()):
        own = [*ids(tokenizer, r.text), 2]
        assert got[r.doc_id] == (start, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes()))
        start += len(own)


def test_files_of_lost_attempts_are_left_out(spark, docs, tmp_path):
    root = f"file://{tmp_path}/out"
    manifest = write_tokens(docs, root, VOCABULARY, shard_ids=5000)
    files = sorted((tmp_path / "out").glob("*.lfpk"))
    want = sorted(map(str, read_tokens(spark, root, manifest).collect()))
    (tmp_path / "out" / "part-000000-000000-999.lfpk").write_bytes(files[0].read_bytes())
    assert sorted(map(str, read_tokens(spark, root, manifest).collect())) == want and len(want) == docs.count()
    assert not (tmp_path / "out" / "_under_way").exists()


def test_token_file_edges(spark, tokenizer):
    rows = token_file_digest(nasty(spark, extra=True), VOCABULARY).collect()
    assert len(rows) == 19 and sum(r.doc_id is None for r in rows) == 2
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()
    assert [r.doc_id for r in rows if r.doc_id is not None] == sorted(r.doc_id for r in rows if r.doc_id is not None)
    assert token_file_digest(empty(spark), VOCABULARY).count() == 0


# 4


def test_contained_items_are_exact(spark, docs, texts):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute.contained(texts, [(r.item_id, r.text) for r in items.collect()])
    assert want and {(r.doc_id, r.item_id) for r in contained_items(docs, items).collect()} == want
    assert {(r.doc_id, r.item_id) for r in contained_items(docs, items, block_items=7).collect()} == want
    kept = {r.doc_id for r in decontaminate(docs, items).collect()}
    assert kept == {d for d, _ in texts} - {d for d, _ in want}


def test_items_inside_long_documents(spark):
    rng = random.Random(9)
    items = [(i, sentence(rng, n)) for i, n in enumerate([5, 7, 12, 20, 33, 60, 150])]
    docs = []
    for i, item in items:
        w = item.split()
        if len(w) > 40:
            w[len(w) // 2] = "changed"
        long = sentence(rng, 6000).split()
        at = rng.randrange(6000)
        docs.append((i, " ".join(long[:at] + w + long[at:])))
    docs.append((99, sentence(rng, 8000)))
    got = {(r.doc_id, r.item_id) for r in contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute.contained(docs, items) and len(got) >= 7


def test_decontamination_edges(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "a B c"), (4, "word"), (4, "word"), (None, "same three words same three words")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id or -1) for r in contained_items(nasty(spark, extra=True), items).collect())
    assert got == [(3, 4), (4, 3), (12, -1)]
    assert contained_items(nasty(spark), items.limit(0)).count() == 0 and contained_items(empty(spark), items).count() == 0
    assert decontaminate(nasty(spark, extra=True), items).count() == 16


# 5


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule(host, path):
    best = None
    for action, r in (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")):
        own, start = r[: r.index("/")], r[r.index("/") :]
        if (host == own or host.endswith("." + own)) and path.startswith(start) and (best is None or len(r) > len(best[1])):
            best = (action, r)
    return best


def test_url_rules(spark):
    urls = ["http://A.Example.COM/en/x?y", "https://www.example.com/en/1", "https://x.www.example.com/en/", "http://com/", "http://com", "http://acom/", "http://a.net/es/1#f", "x.net/fr/", None, "", "a://b://c/d", "http://É.com/é?q#r", "http://h?x/y", "http://a.org/de/1\n2"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls + urls[:2])], "page_id long, url string, host int")
    real = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for df in (pages, real):
        source = {r.page_id: r.url for r in df.collect()}
        rows = judge_urls(df).collect()
        assert len(rows) == df.count()
        for r in rows:
            assert (r.host, r.path) == split_url(source[r.page_id])
            told = rule(r.host, r.path)
            assert r.rule == (told[1] if told else None)
            assert r.verdict == told[0] if told else r.verdict in ("allow", "block")
    assert judge_urls(pages.limit(0)).count() == 0


def test_trees_learn_urls(spark):
    rng = random.Random(4)
    good = [(f"https://site{rng.randrange(50)}.org/articles/{rng.choice('abc')}word/", 0) for _ in range(300)]
    bad = [(f"http://x{rng.randrange(10**9)}.win-{rng.randrange(10**6)}.org/p?id={rng.randrange(10**6)}&a=1&b=2", 1) for _ in range(300)]
    labelled = spark.createDataFrame([(u, y) for u, y in good[:200] + bad[:200]], "url string, label int")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(good[200:] + bad[200:])], "page_id long, url string")
    verdict = {r.page_id: r.verdict for r in judge_urls(pages, rules=(), labelled=labelled).collect()}
    right = sum(verdict[i] == ("block" if i >= 100 else "allow") for i in verdict)
    assert right >= 190


# 6


def test_base_spans_are_exact(spark, docs, texts):
    got = {r.doc_id: r for r in find_pii(docs).collect()}
    for d, t in texts:
        assert got[d].base_sha256 == hashlib.sha256(brute.pii(t).encode()).hexdigest()
        assert set(brute.pii(t).split(",")) <= set(got[d].spans.split(","))


def test_long_texts_with_many_matches(spark):
    text = "ab c@d.ef +1 555 123 4567, " * 6000
    started = time.perf_counter()
    (row,) = find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (row.n_email, row.n_phone, row.n_added) == (6000, 6000, 0)
    assert row.base_sha256 == hashlib.sha256(brute.pii(text).encode()).hexdigest()
    assert time.perf_counter() - started < 60


def test_pii_edges(spark):
    odd = ["x@y.z@a.b a.b@c.d_e@f.g.h 1.2.3.4.5.6.7.8 999.1.1.1 1.2.3.004", "4035 7874-5564  1871 12  34 4035-7874-5564-1871-", "1 " * 400 + "a@b" + ".c" * 400, "+1 2 3" * 300 + "@" * 90, "😀é a@b.c é +12345678901"]
    df = nasty(spark, extra=True).select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    source = {r.doc_id: r.text for r in df.collect()}
    rows = find_pii(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        if r.doc_id is not None:
            want = brute.pii(source[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), r.doc_id
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(k + ":") for k in ("email", "ip", "card", "phone")]
    assert find_pii(empty(spark)).count() == 0


def test_patterns_find_unseen_identifiers(spark):
    rng = random.Random(2)
    rows = [(i, f"{sentence(rng, 5)} reach me via user{i}@mail.example today") for i in range(60)]
    rows += [(100, "reach me via someone9@localhost today"), (101, "nothing here 12345 at all"), (102, "other words someone9@localhost")]
    got = {r.doc_id: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].n_email == 0 and got[100].n_added == 0  # another shape: no dot, so another pattern
    rows += [(i, f"reach me via user{i}@mail.éxample today") for i in range(200, 203)]
    got = {r.doc_id: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].n_email == 0 and got[i].n_added == 1 and got[i].spans.startswith("email:13:") for i in range(200, 203))
    assert got[101].n_added == 0 and got[5].n_added == 0


# 7


def test_classifier_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    quality = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in classify(docs, labels).collect() if r.held_out and r.doc_id in quality]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == quality[r.doc_id] for r in rows) >= 0.97 * len(rows)


def test_classifier_edges(spark):
    labels = spark.createDataFrame([(3, 1, "x"), (4, 0, "y"), (None, 1, "z"), (5, None, "w")], "doc_id long, quality int, text string")
    rows = classify(nasty(spark, extra=True), labels).collect()
    assert len(rows) == 19 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.doc_id == 5}) == 1
    assert {r.score for r in classify(nasty(spark), labels.limit(0)).collect()} == {0.5}
    assert classify(empty(spark), labels).count() == 0


def test_training_rows_are_settled(spark):
    rows = [(i, sentence(random.Random(i), 60) if i % 2 else "!! ## " * 30) for i in range(1, 200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 200)] + [(2, 1), (3, 0)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows + [(7, "!! ## " * 40)] * 50, "doc_id long, text string")
    first = sorted((r.doc_id, r.score) for r in classify(docs, labels).collect())
    assert first == sorted((r.doc_id, r.score) for r in classify(docs.repartition(7), labels.repartition(3)).collect())


def test_features_of_texts(texts):
    some = [t for _, t in texts[:40]] + ["", " \n", "word", "é, b! | é", "a b c a b c a b c\nx\nx"]
    for row, text in zip(_stats.features([t.encode() for t in some]), some):
        data, words = text.encode(), [w.encode() for w in brute.WORD.findall(text)]
        n, size, lines = len(words), len(data), text.count("\n") + 1
        held = [data.count(bytes([b])) for b in range(256)]
        _, _, symbols, duplicates, repeats, _ = brute.base_rules(text)
        of = lambda kinds: sum(held[b] for b in kinds)
        per, nn = max(size, 1), max(n, 1)
        want = [
            np.log1p(n), np.log1p(size), sum(map(len, words)) / nn, len(set(words)) / nn, symbols / per, of(range(48, 58)) / per, of(range(65, 91)) / per,
            sum(held[b] for b in range(33, 127) if not chr(b).isalnum()) / per, held[33] / per, held[124] / per, of(range(128, 256)) / per, duplicates / lines,
            n / lines, repeats / nn, held[46] / nn, held[44] / nn, max(held) / per, -sum(h / per * np.log2(h / per) for h in held if h),
        ]
        assert np.allclose(row, want), text[:40]


def test_trees_against_a_known_rule():
    x = np.random.default_rng(0).normal(size=(600, 4))
    y = ((x[:, 1] > 0) & (x[:, 2] < 0.5)).astype(float)
    model = _gbt.fit(x[:400], y[:400])
    assert ((model.score(x[400:]) > 0.5) == y[400:]).mean() > 0.95
    flat = model.raw(x[:5])
    for row, want in zip(x[:5], flat):
        total = model.base
        for f, c, v in zip(model.feature, model.cut, model.value):
            k = 0
            for _ in range(model.depth):
                k = 2 * k + 1 + (row[f[k]] > c[k])
            total += v[k]
        assert abs(total - want) < 1e-9


# 8


def brute_targets(sizes):
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {k: 1 + i % 3 for i, k in enumerate(names)}
    target, free, total = {}, set(names), sum(sizes.values())
    while free:
        left = total - sum(target.values())
        share = {k: weight[k] * left / sum(weight[x] for x in free) for k in free}
        over = {k for k in free if share[k] > 3 * sizes[k]}
        if not over:
            return target | share
        k = min(over, key=lambda k: 3 * sizes[k] / weight[k])
        target[k] = 3.0 * sizes[k]
        free.discard(k)
    return target


def test_mix(spark, docs):
    for df in (docs, nasty(spark, extra=True), docs.withColumn("source", F.when(F.col("doc_id") < 150, "big").when(F.col("doc_id") < 190, None).otherwise(F.concat(F.lit("t"), F.col("doc_id") % 4)))):
        sources, size = {}, {}
        for r in df.collect():
            sources.setdefault(r.source, []).append(len(brute.WORD.findall(r.text or "")))
        size = {k: sum(v) for k, v in sources.items()}
        rows = mix_sources(df, columns=["doc_id", "source"]).collect()
        assert len(rows) == df.count()
        want = brute_targets(size)
        taken = {}
        for r in rows:
            assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
            assert r.taken % max(1, r.size) == 0 and 0 <= r.taken <= 3 * r.size
            taken[r.source] = taken.get(r.source, 0) + r.taken
        for k in size:
            assert abs(taken[k] - want[k]) <= 2 * max(sources[k]) + 1
        again = mix_sources(df.repartition(7), columns=["doc_id", "source"]).collect()
        assert sorted(map(str, rows)) == sorted(map(str, again))
        assert mixed_documents(df).count() == sum(r.copies for r in rows)
    assert mix_sources(empty(spark)).count() == 0 and mixed_documents(empty(spark)).count() == 0


# 9

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div><article><h1>Head &amp; &#233;</h1><p><b>One<br><p>two
  three</p><aside>side</aside><div class="comments"><p>first!</p></div><p>&lt;tag&gt;</p></article><form><p>sign up</p></form><footer>&copy; x</footer></body></html>"""


def test_article_text(spark):
    pages = spark.createDataFrame([(1, "http://h/a", PAGE, 1), (2, None, PAGE, 1), (3, "http://h/b", None, 1), (4, "http://h/b", "", 1), (4, "http://h/b", "", 1), (None, "http://h/c", PAGE[: PAGE.index("three") + 5] + "</p", 1)], "page_id long, url string, html string, path int")
    got = {(r.page_id, r.url): r.text for r in main_text(pages).collect()}
    full = "Head & é\nOne\ntwo three\n<tag>"
    assert got[1, "http://h/a"] == got[2, None] == full and got[3, "http://h/b"] == got[4, "http://h/b"] == ""
    assert got[None, "http://h/c"] == "Head & é\nOne\ntwo three"
    assert all(r.n_chars == len(r.text) for r in main_text(pages).collect())
    assert main_text(pages.limit(0)).count() == 0


def test_neighbours_delete_shared_open_lines(spark):
    def page(i):
        return f"<html><body><p>Site name</p><p>own text {i}</p><div>more {i}</div><p>All rights reserved</p></body></html>"

    pages = spark.createDataFrame([(i, f"http://h{i % 2}/d/{i}", page(i)) for i in range(40)] + [(99, "http://alone/x", page(99))], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text(pages.repartition(5)).collect()}
    assert all(got[i] == f"own text {i}\nmore {i}" for i in range(40))
    assert got[99] == "Site name\nown text 99\nmore 99\nAll rights reserved"


def brute_open_text(pages):
    """Text of pages of <p> lines without markup of regions, by the definition: nearest path, longest common subsequence, copies passed over."""

    def common(a, b):
        """Places in a of one longest common subsequence of lines that don't repeat."""
        best = [[()] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + (i,) if x == y else max(best[i][j + 1], best[i + 1][j], key=len)
        return set(best[-1][-1])

    rows = sorted((split_url(u), p, re.findall("<p>(.*?)</p>", h)) for p, u, h in pages)
    out = {}
    for i, ((host, path), page, lines) in enumerate(rows):
        near = [rows[k] for k in (i - 1, i + 1) if 0 <= k < len(rows) and rows[k][0][0] == host]
        near.sort(key=lambda r: -next((n for n, (x, y) in enumerate(zip(r[0][1], path)) if x != y), min(len(r[0][1]), len(path))))
        lost = set()
        for r in near:
            lost = common(lines, r[2])
            a, b, both = (sum(len(x.split()) for x in y) for y in (lines, r[2], [lines[k] for k in lost]))
            if 100 * both < 80 * (a + b - both):
                break
            lost = set()
        out[page] = "\n".join(x for k, x in enumerate(lines) if k not in lost)
    return out


def test_differencing_is_the_definitions(spark):
    rng = random.Random(12)
    pages = []
    for i in range(120):
        site = [f"site {i % 3} {k}" for k in range(rng.randrange(4))]
        own = [f"{sentence(rng, 6)} {i}" for _ in range(rng.randrange(5))]
        if i % 9 == 0 and pages:  # a copy under another path
            pages.append((i, f"http://h{i % 3}/c/{rng.randrange(50)}/{i}", pages[rng.randrange(len(pages))][2]))
            continue
        turn = [own] * len(own) + [site] * len(site)  # site lines keep their order, so there is one longest common subsequence
        rng.shuffle(turn)
        lines = [x.pop(0) for x in turn]
        pages.append((i, f"http://h{i % 3}/{rng.choice('ab')}/{rng.randrange(50)}/{i}", "".join(f"<p>{x}</p>" for x in lines)))
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want = brute_open_text(pages)
    assert got == want and sum(want[p] != "\n".join(re.findall("<p>(.*?)</p>", h)) for p, _, h in pages) > 40


def test_copies_keep_their_text(spark):
    html = "<p>one text of some words</p><p>and a second line of it</p>"
    pages = spark.createDataFrame([(i, f"http://h/{i}", html) for i in range(3)], "page_id long, url string, html string")
    assert {r.text for r in main_text(pages).collect()} == {"one text of some words\nand a second line of it"}


def test_pages_with_articles_are_paired_with_their_neighbours(spark):
    """Differencing judges every page; the check by regions brings article lines back and takes furniture out."""
    rng = random.Random(31)
    own = [[f"{sentence(rng, 9)} {i} {k}" for k in range(4)] for i in range(40)]
    page = lambda i: "<nav>Menu</nav><p>Site<article>" + "".join(f"<p>{x}" for x in [*own[i], "Same line"]) + f"</article><p>beside {i}<footer>by {i}</footer>"
    pages = spark.createDataFrame([(i, f"http://h/{i:02}", page(i)) for i in range(40)], "page_id long, url string, html string")
    got = {r.page_id: r for r in main_text(pages.repartition(5), max_broadcast=0).collect()}
    assert all(got[i].text == "\n".join([*own[i], "Same line"]) for i in range(40))
    assert all((r.n_shared, r.n_restored) == (3, 1) for r in got.values())
    copies = spark.createDataFrame([(i, f"http://h/{i:02}", page(0)) for i in range(3)], "page_id long, url string, html string")
    assert {(r.n_shared, r.n_restored) for r in main_text(copies).collect()} == {(0, 0)}


@pytest.mark.parametrize("size", [1, 2, 4, 100])
def test_neighbours_across_runs(spark, size):
    lines = [(i, 0, "h", f"/{i}", [1, 10 + i], [1, 3]) for i in range(9)]
    rows = spark.createDataFrame(lines, "page_id long, digest long, host string, path string, keys array<long>, words array<int>")
    assert {(r.page_id, *r.gone) for r in deleted_lines(rows, size).collect()} == {(i, 0) for i in range(9)}


def test_marks_of_whole_pages_and_articles():
    lines = page_lines('<body class="with-sidebar"><article class="has-comments"><h1 class="article-header">T</h1><p data-id="ad">x</p><div class="share">s</div></article></body>')
    assert [(t, r) for t, r in lines] == [("T", 0), ("x", 0), ("s", 1)]


def article(html):
    return [t for t, r in page_lines(f"<article>{html}</article>") if r == 0]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p class='ad'>Buy now<p>Real text one.<p>Real two.", ["Real text one.", "Real two."]),
        ("<ul><li class='promo'>Buy<li>one<li>two<ul><li class=ad>x<li>three</ul>end</ul>", ["one", "two", "three", "end"]),
        ("<dl><dt class=ad>Buy<dd>one<dt>two<dd class=ad>x<dt>three</dl>", ["one", "two", "three"]),
        ("<table><tr><td class=ad>Buy<td>one<tr class=ad><td>x<tr><td>two</table>", ["one", "two"]),
        ("<table><tr><td><div><p class=ad>Buy</td><td>one</td></tr></table>", ["one"]),
        ("<table><caption class=ad>x<tr><td>one<tbody class=ad><tr><td>x<tbody><tr><td>two</table><p>three", ["one", "two", "three"]),
        ("<p class=ad>Buy<div>one</div><p class=ad>x<h2>two</h3><p>three", ["one", "two", "three"]),
        ("<p class=ad>x<span>y</p>one", ["one"]),
        ("<div class=ad><b>x</div>one</b> two", ["one two"]),
        ("<section id='related-work'>one</section><section id='social-impact'>two</section><p class='share-price'>three", ["one", "two", "three"]),
        ("<div class='share-buttons'>x</div><div id='relatedPosts'>x</div><div class='big ad-slot-2'>x</div><p>one", ["one"]),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be<svg><text>drawn</text></svg> <canvas>plot</canvas> <object>file</object>", ["Let x=2 bedrawn plot file"]),
        ("<p>one<script>x</script><style>y</style><noscript>z</noscript><textarea>v</textarea><iframe>w</iframe> two", ["one two"]),
        ("<select><option>x<option>y</select><button>z</button><form>v</form>one", ["one"]),
        ("<p>one <button>x</button><span class=ad>y</span>two<div><span class='ad'>z</span></div>", ["one two"]),
        ("<header>own header</header><p>one<footer>x</footer>", ["own header", "one"]),
        ("<img src='a>b'/><p/>one<hr>two<br/>three", ["one", "two three"]),
    ],
)
def test_article_lines(html, want):
    assert article(html) == want


def test_reader_comments_are_no_article():
    html = "<main><article class='post has-comments'><p>one</article><article class='comment'><p>x</article><section id=comments><article><p>y</article></section></main>"
    assert [t for t, r in page_lines(html) if r == 0] == ["one"]
    assert [t for t, r in page_lines("<article class='comment'>x</article><p>one") if r == 2] == ["one"]


ELEMENTS = {"p": "", "li": "ul", "dt": "dl", "dd": "dl", "td": "tr", "tr": "table", "div": "", "section": "", "h2": "", "blockquote": ""}


def grown(rng, depth, hidden, count):
    """Random blocks as (markup with every end tag, the same without those that may be left out, texts that show)."""
    whole, short, shown = [], [], []
    for _ in range(rng.randrange(1, 4)):
        kind = rng.choice(["p", "ul", "dl", "table", "div", "section", "h2"] if depth else ["p", "h2"])
        out = rng.random() < 0.25
        mark = rng.choice([' class="ad"', " id=sidebar", ' role="navigation"', ' class="wide share-links"']) if out else rng.choice(["", ' class="related-work"', " id=x"])
        hide = hidden or out

        def text():
            count[0] += 1
            if not hide:
                shown.append(f"t{count[0]} é")
            return f"t{count[0]} <b>&eacute;</b>"

        def inner():
            a, b, c = grown(rng, depth - 1, hide, count)
            shown.extend(c)
            return a, b

        if kind in ("p", "h2"):
            t = text()
            whole.append(f"<{kind}{mark}>{t}</{kind}>")
            short.append(f"<p{mark}>{t}" if kind == "p" else whole[-1])
        elif kind in ("ul", "dl", "table"):
            a, b = "", ""
            for _ in range(rng.randrange(1, 4)):
                if rng.random() < 0.5 and depth > 1:
                    t, u = inner()
                else:
                    t = u = text()
                open_, end = {"ul": ("<li>", "</li>"), "dl": (rng.choice([("<dt>", "</dt>"), ("<dd>", "</dd>")])), "table": ("<tr><td>", "</td></tr>")}[kind]
                a, b = a + open_ + t + end, b + open_ + u
            whole.append(f"<{kind}{mark}>{a}</{kind}>")
            short.append(f"<{kind}{mark}>{b}</{kind}>")
        else:
            t, u = inner()
            whole.append(f"<{kind}{mark}>{t}</{kind}>")
            short.append(f"<{kind}{mark}>{u}</{kind}>")
    return "".join(whole), "".join(short), shown


def test_omitted_end_tags_change_nothing():
    rng = random.Random(21)
    some = 0
    for _ in range(400):
        whole, short, shown = grown(rng, 3, False, [0])
        assert article(whole) == shown and article(short) == shown
        some += bool(shown) and whole != short
    assert some > 200


def test_a_page_that_is_mostly_template_loses_it(spark):
    rng = random.Random(22)
    site = [sentence(rng, 20) for _ in range(4)]
    pages = [(i, f"http://h/{i}", "".join(f"<p>{x}" for x in [*site[:2], f"{sentence(rng, 25)} {i}", *site[2:]])) for i in range(12)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(len(t.split()) == 26 and t.endswith(f" {i}") for i, t in got.items())


def test_longest_common_subsequence():
    rng = random.Random(6)
    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = shared_lines(a, b)
        assert len(found) == table[-1][-1] and found == sorted(set(found))
        at = iter(b)
        assert all(a[i] in at for i in found)
    assert page_lines(None) == [] and page_lines("<p>a") == [("a", 2)]


# 10


def test_base_rules(spark, docs):
    for df in (docs, nasty(spark, extra=True)):
        source = sorted((r.doc_id or -1, *brute.base_rules(r.text)) for r in df.collect())
        rows = quality_rules(df).collect()
        assert sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == source
        assert all(not r.kept for r in rows if r.base_failed)
    assert quality_rules(empty(spark)).count() == 0


@pytest.mark.parametrize("max_broadcast", [1000, 1])
def test_templates_are_removed_and_depleted_documents_rejected(spark, max_broadcast):
    rng = random.Random(7)
    head, foot = sentence(rng, 30), sentence(rng, 40)
    rows = [(i, f"{head}\n{sentence(rng, 80)}\n{foot}", "en", "host", 0) for i in range(60)]
    rows += [(100 + i, f"{head}\n{foot}\n{sentence(rng, 3)}", "en", "host", 0) for i in range(3)]
    rows += [(200, f"{head}\n{foot}", "en", "other", 0)]
    copies = sentence(rng, 90)
    rows += [(300 + i, copies, "en", "host", 0) for i in range(50)]
    df = spark.createDataFrame(rows, DOCS)
    kept = {r.doc_id: r.kept for r in quality_rules(df, max_broadcast=max_broadcast).collect()}
    assert all(kept[i] for i in [*range(60), 200, *range(300, 350)]) and not any(kept[i] for i in range(100, 103))
    clean = {r.doc_id: r for r in apply_quality_rules(df, max_broadcast=max_broadcast).collect()}
    assert head not in clean[0].text and "\n" not in clean[0].text and clean[0].n_chars == len(clean[0].text)
    assert clean[200].text == f"{head}\n{foot}"
