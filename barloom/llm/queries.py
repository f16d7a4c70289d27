"""One registered query per operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barloom.llm import context_tree, html_main, idstore, mixing, ngram_join, packing, pii, prefix_trie, quality, secrets, spelling, tiff, tokens
from barloom.llm.shared import place

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


@query
def op3_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.round_trip(table(spark, sf_dir, "documents"))


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return tokens.attributed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL["op6_ngram_join"] = rf"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
d AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM d a JOIN d b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.node)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(node) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""


@query
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


@query
def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken")


@query
def op8_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = place(spark, "ids")
    idstore.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end=1)
    return idstore.read(spark, folder)


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=0)
    return packing.pack(cut)


@query
def op10_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


@query
def op11_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.scored(table(spark, sf_dir, "documents"))


#: CRC-32 of a list of bytes in SQL; ``t`` is the table of its 256 steps
CRC_TABLE = ("SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),"
             " lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t")


def crc_sql(codes: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295)"


SQL["op12_prefix_trie"] = rf"""WITH crc AS ({CRC_TABLE}),
o AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(coalesce(role, '')), encode(coalesce(text, ''))) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS k FROM o GROUP BY conv_id),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {crc_sql("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))")} % 9 AS h FROM n, crc),
u AS (SELECT c.conv_id, o.pos, r, x FROM c JOIN o ON o.conv_id = c.base WHERE o.pos < h
  UNION ALL SELECT c.conv_id, o.pos - h + least(h, coalesce(n.k, 0)), r, x FROM c JOIN o ON o.conv_id = c.conv_id LEFT JOIN n ON n.conv_id = c.base WHERE o.pos >= h),
l AS (SELECT c.conv_id, coalesce(list(md5(length(r) || ':' || r || x) ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS turns,
  coalesce(list(strlen(x) ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS sizes FROM c LEFT JOIN u ON u.conv_id = c.conv_id GROUP BY c.conv_id),
p AS (SELECT conv_id, d, turns[1:d] AS path, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, d = len(turns) AS ends
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM l)),
v AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size,
  coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ends FROM p GROUP BY path, d),
k AS (SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS n_children FROM v WHERE d > 0 GROUP BY 1, 2),
a AS (SELECT v.*, coalesce(k.n_children, 0) AS n_children FROM v LEFT JOIN k ON k.d = v.d AND k.path = v.path),
t AS (SELECT path[1:j] AS path, j AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * size) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM a) GROUP BY 1, 2)
SELECT a.conv_id, a.d AS depth, up.conv_id AS parent_conv_id, a.n_convs, a.n_children, CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens,
  sha256(a.ends) AS ends_sha256 FROM a JOIN t ON t.d = a.d AND t.path = a.path LEFT JOIN v up ON up.d = a.d - 1 AND up.path = a.path[1:a.d - 1]"""


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


SQL["op13_spelling"] = rf"""WITH RECURSIVE crc AS ({CRC_TABLE}),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
p AS (SELECT doc_id, run, count(*) AS k FROM r GROUP BY doc_id, run),
h AS (SELECT run, k, {crc_sql("flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(ord(x) - 64 AS BIGINT)] END))")} AS h FROM p, crc
  WHERE length(run) >= 6),
w AS (SELECT word, sum(k) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, k FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
d AS (SELECT DISTINCT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (SELECT a.word AS a, b.word AS b, b.n AS m FROM d a JOIN d b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM w a JOIN d b ON a.word = b.cut UNION SELECT a.word, b.word, b.n FROM d a JOIN w b ON a.cut = b.word),
o AS (SELECT a, b, m, row_number() OVER (PARTITION BY a ORDER BY m DESC, encode(b)) AS place, count(*) OVER (PARTITION BY a) AS n_near FROM e),
f AS (SELECT w.word, w.n, coalesce(o.n_near, 0) AS n_near, CASE WHEN o.m >= 5 * w.n THEN o.b END AS form, CASE WHEN o.m >= 5 * w.n THEN o.m END AS form_n
  FROM w LEFT JOIN o ON o.a = w.word AND o.place = 1),
g AS (SELECT word, word AS root, form FROM f UNION ALL SELECT g.word, f.word, f.form FROM g JOIN f ON f.word = g.form)
SELECT f.word, f.form, g.root, CAST(f.n AS BIGINT) AS n, f.n_near, CAST(f.form_n AS BIGINT) AS form_n FROM f JOIN g ON g.word = f.word AND g.form IS NULL"""


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))
