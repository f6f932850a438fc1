"""Thin queries over the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm.decontaminate import contained_items
from lumenframe.llm.exact_topk import exact_topk
from lumenframe.llm.ngram_join import ngram_jaccard_join
from lumenframe.llm.packed_tokens import token_file_digest
from lumenframe.llm.page_text import main_text
from lumenframe.llm.pii import find_pii
from lumenframe.llm.quality_classifier import classify
from lumenframe.llm.quality_rules import quality_rules
from lumenframe.llm.source_mix import mix_sources
from lumenframe.llm.spelling import spelling_variants
from lumenframe.llm.token_counts import token_counts
from lumenframe.llm.url_filter import judge_urls
from lumenframe.llm.whitening import whitened_components

VOCABULARY = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).drop("copies")


def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(_table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_ngram_jaccard_join,
        op2_token_counts,
        op3_token_output,
        op4_decontaminate,
        op5_url_filter,
        op6_pii,
        op7_quality_classifier,
        op8_source_mix,
        op9_page_text,
        op10_quality_rules,
        op11_embedding_whitening,
        op12_spelling_variants,
        op13_exact_topk,
    ]
    return {f.__name__: f for f in found}


def _shingles(table: str, key: str, name: str) -> str:
    """Distinct five-word shingles of a table's texts, as a CTE; fewer words make one."""
    folded = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""{name}_w AS (SELECT {key}, regexp_extract_all({folded}, '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
{name} AS (SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i : array_to_string(w[i : i + 4], chr(31))) WHEN len(w) > 0 THEN [array_to_string(w, chr(31))] ELSE [] END) AS shingle FROM {name}_w)"""


OP1_SQL = f"""WITH RECURSIVE {_shingles("documents", "doc_id", "s")},
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
held AS (SELECT shingle FROM s GROUP BY 1 HAVING count(*) > 1),
h AS (SELECT s.* FROM s JOIN held USING (shingle)),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM h a JOIN h b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT DISTINCT x AS id, x AS other FROM edges UNION SELECT r.id, e.y FROM reach r JOIN edges e ON r.other = e.x),
parts AS (SELECT id, min(other) AS component FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(p.component, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN parts p ON p.id = d.doc_id"""

OP4_SQL = f"""WITH {_shingles("documents", "doc_id", "s")}, {_shingles("benchmark", "item_id", "b")},
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY 1),
m AS (SELECT s.doc_id, b.item_id, count(*) AS n_shared FROM s JOIN b ON s.shingle = b.shingle GROUP BY 1, 2)
SELECT doc_id, m.item_id, n_shared, n_item, n_shared::DOUBLE / n_item::DOUBLE AS containment FROM m JOIN n ON m.item_id = n.item_id WHERE 100 * n_shared >= 80 * n_item"""

OP8_SQL = """WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * CAST(sum(size) AS BIGINT) AS cap FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER w AS stop, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS caps,
  CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest FROM s WINDOW w AS (ORDER BY cap::DOUBLE / weight::DOUBLE, source NULLS LAST)),
f AS (SELECT * FROM o WHERE cap * rest >= weight * (total - caps) ORDER BY stop LIMIT 1),
t AS (SELECT o.source, o.source_size, CASE WHEN o.stop < f.stop THEN o.cap::DOUBLE ELSE o.weight::DOUBLE * (f.total - f.caps)::DOUBLE / f.rest::DOUBLE END AS target FROM o, f),
q AS (SELECT d.*, t.source_size, t.target, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT doc_id, place, size, (source_size * k + upto)::DOUBLE / target AS v FROM q, range(0, 3) r(k) WHERE size > 0),
e AS (SELECT doc_id, size, coalesce(sum(size) OVER (ORDER BY v, place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM c),
k AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM e WHERE spent < (SELECT sum(size) FROM d) GROUP BY 1)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0) AS taken FROM q LEFT JOIN k ON q.doc_id = k.doc_id"""

#: The checksum is CRC-32 by its table; near words are found by what is left of them without one code point.
OP12_SQL = """WITH RECURSIVE tbl AS MATERIALIZED (SELECT list_transform(range(0, 256), lambda x : list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z : CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
o AS MATERIALIZED (SELECT d, run, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]{7,}')) AS run FROM documents) GROUP BY 1, 2),
bytes AS (SELECT d, run, n, flatten(list_transform(string_split(concat(d, ':', run), ''), lambda c : CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, 128 + unicode(c) % 64] END)) AS b FROM o),
sums AS (SELECT d, run, n, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(b, lambda x : CAST(x AS BIGINT))), lambda c, x : xor(c // 256, t[xor(c % 256, x) + 1]))) AS h FROM bytes, tbl),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN concat(left(run, CAST(h % length(run) AS BIGINT)), substr(run, CAST(h % length(run) AS BIGINT) + 2)) ELSE run END AS word FROM sums) WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
less AS MATERIALIZED (SELECT word, n, i, concat(left(word, i - 1), substr(word, i + 1)) AS rest FROM words, range(1, length(word) + 1) r(i)),
pairs AS (SELECT l.word AS a, w.word AS b FROM less l JOIN words w ON l.rest = w.word UNION SELECT x.word, y.word FROM less x JOIN less y ON x.rest = y.rest AND x.i = y.i AND x.word < y.word),
near AS (SELECT p.a, p.b FROM pairs p UNION SELECT p.b, p.a FROM pairs p),
best AS MATERIALIZED (SELECT a AS word, count(*) AS n_near, arg_min(struct_pack(form := b, n := w.n), struct_pack(k := -w.n, form := b)) AS f FROM near JOIN words w ON w.word = b GROUP BY 1),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.f.n >= 10 * w.n THEN b.f.form END AS form, CASE WHEN b.f.n >= 10 * w.n THEN b.f.n END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON f.word = e.word"""

OP13_SQL = """WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x : floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""


def oracle_sql() -> dict[str, str]:
    """The operators whose full rows SQL gives; the tests hold the others against brute force."""
    return {"op1_ngram_jaccard_join": OP1_SQL, "op4_decontaminate": OP4_SQL, "op8_source_mix": OP8_SQL, "op12_spelling_variants": OP12_SQL, "op13_exact_topk": OP13_SQL}
