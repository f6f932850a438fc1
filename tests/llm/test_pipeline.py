"""The pipeline, stage by stage, against brute force."""

from __future__ import annotations

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lumenframe.llm.queries import OP8_SQL
from tests.llm import brute
from tests.llm.test_operators import DOCS, empty, nasty, sentence
from tests.llm.test_quality_lines import brute_verdicts


def test_each_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "decontamination", "mixing", "token_files"]
    rows = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        found = out.collect()
        if name != "token_files":
            assert out.columns == docs.columns
        if name == "quality_rules":
            assert {r.doc_id for r in found} == {d for d, (_, kept) in brute_verdicts([tuple(r) for r in rows], 20, 0.3).items() if kept}
        if name == "near_duplicates":
            parts = brute.components([(r.doc_id, r.text) for r in rows])
            assert {r.doc_id for r in found} == {d for d, (_, c) in parts.items() if c == d}
        if name == "decontamination":
            gone = {d for d, _ in brute.contained([(r.doc_id, r.text) for r in rows], items)}
            assert gone and {r.doc_id for r in found} == {r.doc_id for r in rows} - gone
        if name == "mixing":
            con = duckdb.connect()
            con.register("documents", docs.toArrow())
            taken = {doc: words // size for doc, size, _, _, words in con.execute(OP8_SQL).fetchall() if size}
            assert all(found.count(r) == taken.get(r.doc_id, 0) for r in rows) and set(found) <= set(rows) and max(taken.values()) > 1
        if name == "token_files":
            t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            want = sorted((r.doc_id, len(t.encode(r.text, add_special_tokens=False).ids) + 1) for r in rows)
            assert sorted((r.doc_id, r.n_tokens) for r in found) == want
            break
        docs = spark.createDataFrame(found, docs.schema) if found else out
        rows = found


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, sf_dir, name, stage):
    """Nulls in every column, empty and long texts, repeated rows, clashing names."""
    df = nasty(spark, extra=True)
    out = stage(spark, df, sf_dir)
    rows = out.collect()
    if name == "token_files":
        assert len(rows) == df.count()
        return
    assert out.columns == df.columns
    kept, all_ = [r.text for r in rows], {r.text for r in df.collect()}
    if name == "quality_rules":
        assert not {None, "", " \n\t ", "Word"} & set(kept) and len(kept) == sum(not brute.base_rules(t)[-1] for t in (r.text for r in df.collect()))
    else:
        assert set(kept) <= all_
    if name == "near_duplicates":
        assert kept.count(None) == 2  # a document without words, and a row without an id
    if name == "mixing":
        assert None not in kept and "" not in kept


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_empty_tables(spark, sf_dir, name, stage):
    assert stage(spark, empty(spark), sf_dir).count() == 0


def test_lines_are_removed_before_later_stages(spark, sf_dir):
    """A passage that many documents of a host share goes; what is left decides which documents are copies."""
    import random

    rng = random.Random(21)
    passage = sentence(rng, 60)
    rows = [(i, f"{passage}\n{sentence(rng, 70)}", "en", "h", 0) for i in range(40)]
    rows += [(100, rows[3][1].split("\n")[1], "en", "h", 0)]
    docs = corpus_pipeline.quality(spark, spark.createDataFrame(rows, DOCS), sf_dir)
    assert docs.where(F.contains("text", F.lit(passage))).count() == 0 and docs.count() == 41
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()) == list(range(40))
