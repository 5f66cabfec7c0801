"""The text operators as queries over the given tables, with SQL of the same results where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, lines, mix, neardup, passages, phrases, pii, quality, spelling, stream_bpe, token_counts, toxicity
from .store import table, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    return mix.mix(docs, "doc_id", "source", "size").select("doc_id", "source", "size", "source_size", "target", "epochs", "taken")


@query
def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0)


@query
def op3_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", token_counts.count_tokens(F.col("text"), path).alias("n_tokens"))


@query
def op4_find_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.private_data(docs, "text")
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2(F.encode(pii.listed(F.col("plain")), "UTF-8"), 256).alias("base_sha256"),
                        pii.listed(F.col("spans")).alias("spans"))


@query
def op5_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .store import written

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    measured = written(quality.measure(docs, "text").drop("text"))
    judged = quality.judge(measured, quality.learn(measured, "lang", "source"), "lang", "source")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op6_drop_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = passages.drop_repeated_passages(table(spark, sf_dir, "documents"), "doc_id", "text")
    return left.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@query
def op7_drop_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@query
def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = docs.select("doc_id", bpe.encode(F.col("text"), *how).alias("ids")).withColumn("decoded", bpe.decode(F.col("ids"), *how))
    return coded.select("doc_id", bpe.token_count(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op9_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.fit(docs.where(~held_out), table(spark, sf_dir, "labels"), "doc_id", "text", "lang", "toxic")
    scored = toxicity.classify(docs, model, "text", "lang")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "toxic")


@query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", width=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                        (F.col("id") == F.col("component")).alias("kept"))


@query
def op11_stream_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = docs.select("doc_id", stream_bpe.encode(F.col("text"), path).alias("ids")).withColumn("decoded", stream_bpe.decode(F.col("ids"), path))
    return coded.select("doc_id", bpe.token_count(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), "lang", "text")


SQL["op1_mix_sources"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS rank FROM s),
w AS (SELECT *, [3, 1, 2][((rank - 1) % 3 + 1)::INT] AS weight, source_size * 2 AS most FROM r),
o AS (SELECT *, most / weight AS full_at FROM w),
g AS (SELECT *, coalesce(sum(most) OVER b, 0) AS given, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS left_weight,
  sum(source_size) OVER () AS total FROM o
  WINDOW b AS (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (total * 3 - given * 2)::HUGEINT AS rest, most::HUGEINT * left_weight::HUGEINT * 2 > weight::HUGEINT * (total * 3 - given * 2)::HUGEINT AS open FROM g),
one AS (SELECT full_at AS f0, rank AS r0, rest AS rest0, left_weight AS lw0 FROM f WHERE open ORDER BY full_at, rank LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN f0 IS NULL OR (full_at, rank) < (f0, r0) THEN most::DOUBLE
  ELSE (weight::HUGEINT * rest0)::DOUBLE / (lw0 * 2)::DOUBLE END AS target FROM f LEFT JOIN one ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS epochs FROM t),
k AS (SELECT d.*, ('0x' || substr(md5('1' || chr(31) || coalesce(doc_id::VARCHAR, '-')), 1, 15))::BIGINT AS key FROM d),
p AS (SELECT k.*, source_size, target, epochs, floor(target)::BIGINT - epochs * source_size AS rest,
  sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, target, epochs,
  (epochs * size + greatest(0, least(size, rest - (upto - size))))::BIGINT AS taken FROM p"""

_BIN = "CASE WHEN {0} > 0 THEN greatest(ceil(ln({0}) / ln(1.02))::INT + 600, 1) ELSE 0 END"
_SHARES = ", ".join(f"('{r}', {v[0]}, {v[1] if len(v) > 1 else 'NULL'}::INT)" for r, v in quality.RULES.items())

SQL["op5_adaptive_quality"] = r"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
h AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS h FROM v),
c AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS n FROM h) WHERE n > 1),
rw AS (SELECT doc_id, sum(least(8, i - p)) AS n FROM (SELECT *, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) AS p FROM c) GROUP BY doc_id),
m AS (SELECT w.*, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rw USING (doc_id)),
x AS (SELECT *, n_symbols / greatest(n_words, 1) AS a, n_repeat_words / greatest(n_words, 1) AS b, n_dup_lines / greatest(len(ls), 1) AS c1,
  len(regexp_extract_all(text, '[A-Z]')) / greatest(word_chars, 1) AS d, n_words / greatest(len(list_distinct(ws)), 1) AS e,
  word_chars / greatest(n_words, 1) AS f FROM m),
y AS (SELECT doc_id, lang, source, unnest([{'rule': 'symbols', 'bin': A}, {'rule': 'repeats', 'bin': B}, {'rule': 'lines', 'bin': C},
  {'rule': 'capitals', 'bin': D}, {'rule': 'per_distinct', 'bin': E}, {'rule': 'word_length', 'bin': F}]) AS z FROM x),
bins AS (SELECT doc_id, lang, source, z.rule AS rule, z.bin AS bin FROM y),
share(rule, up, down) AS (VALUES SHARES),
lv AS (SELECT 0 AS level, lang, source, rule, bin FROM bins UNION ALL SELECT 1, lang, NULL, rule, bin FROM bins UNION ALL SELECT 2, NULL, NULL, rule, bin FROM bins),
q AS (SELECT level, lang, source, rule, count(*) AS n, list_sort(list(bin)) AS l FROM lv GROUP BY level, lang, source, rule),
qq AS (SELECT level, lang, source, rule, n, l[((n + 1) // 2)::INT] AS mid, l[((up * n + 999) // 1000)::INT] AS high, l[((down * n + 999) // 1000)::INT] AS low
  FROM q JOIN share USING (rule)),
own AS (SELECT level, lang, source, rule, n, CASE WHEN mid > 0 THEN high + greatest((high - mid) * 2, 5) ELSE high END AS upper,
  CASE WHEN low IS NOT NULL THEN greatest(low - greatest((mid - low) * 2, 5), 0) END AS lower FROM qq),
one AS (SELECT o.lang, o.rule, (o.n * o.upper + 20 * a.upper) // (o.n + 20) AS upper, (o.n * o.lower + 20 * a.lower) // (o.n + 20) AS lower
  FROM own o JOIN own a ON o.level = 1 AND a.level = 2 AND a.rule = o.rule),
lim AS (SELECT o.lang, o.source, o.rule, (o.n * o.upper + 20 * l.upper) // (o.n + 20) AS upper, (o.n * o.lower + 20 * l.lower) // (o.n + 20) AS lower
  FROM own o JOIN one l ON o.level = 0 AND l.rule = o.rule AND l.lang IS NOT DISTINCT FROM o.lang),
bad AS (SELECT doc_id, bool_or(bin > upper OR coalesce(bin < lower, false)) AS out
  FROM bins JOIN lim ON lim.rule = bins.rule AND lim.lang IS NOT DISTINCT FROM bins.lang AND lim.source IS NOT DISTINCT FROM bins.source GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT out AS kept FROM x JOIN bad USING (doc_id)""".replace("SHARES", _SHARES)
for _at, _name in zip("ABCDEF", ("a", "b", "c1", "d", "e", "f"), strict=True):
    SQL["op5_adaptive_quality"] = SQL["op5_adaptive_quality"].replace(f"'bin': {_at}}}", f"'bin': {_BIN.format(_name)}}}")

SQL["op6_drop_repeated_passages"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
h AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS h FROM v),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM c),
g AS (SELECT doc_id, list(p) AS gone FROM p GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_filter(ws, lambda x, i: NOT coalesce(list_contains(gone, i), false)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)"""

SQL["op10_near_duplicates"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS g FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""

SQL["op12_spelling_variants"] = r"""
WITH RECURSIVE bits AS (SELECT i, i AS c, 0 AS step FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
u AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
o AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM u GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(key) + 1),
    lambda i: ('0x' || substr(hex(encode(key)), (2 * i - 1)::INT, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || run AS key FROM o), crc),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT *, unnest(range(1, length(word) + 1))::INT AS i FROM v)),
p AS (SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM d x JOIN d y ON x.less = y.less AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, x.n, y.word, y.n FROM d x JOIN v y ON x.less = y.word UNION SELECT y.word, y.n, x.word, x.n FROM d x JOIN v y ON x.less = y.word),
b AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM p),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n
  FROM v LEFT JOIN b ON b.word = v.word AND k = 1),
r AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT r.word, f.form, step + 1 FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
z AS (SELECT word, arg_max(root, step) AS root FROM r GROUP BY word)
SELECT word, n, n_near, form, form_n, root FROM f JOIN z USING (word)"""

SQL["op13_collocations"] = r"""
WITH s AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM s),
g AS (SELECT lang, ws, d, unnest(range(1, len(ws) - d + 2)) AS i FROM p, range(1, 6) t(d) WHERE len(ws) >= d),
f AS (SELECT lang, d, array_to_string(ws[i:i + d - 1], ' ') AS phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE d >= 2),
k AS (SELECT lang, d, phrase, a, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:], ' ') AS y FROM c, range(1, 5) t(k) WHERE k < d),
q AS (SELECT k.lang, k.phrase, k.a, t.n, k.k, l.a AS l, r.a AS r, (1000::HUGEINT * k.a::HUGEINT * t.n::HUGEINT) // (l.a::HUGEINT * r.a::HUGEINT) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = x JOIN f r ON r.lang = k.lang AND r.phrase = y JOIN t ON t.lang = k.lang),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM q) WHERE nth = 1),
i AS (SELECT lang, array_to_string(ws[j:j + m - 1], ' ') AS phrase, max(a) AS longer FROM c, range(2, 5) t(m), range(1, 5) u(j)
  WHERE m < d AND j + m - 1 <= d GROUP BY ALL),
o AS (SELECT w.* FROM w LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR NOT 100 * longer >= 100 * a),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM z WHERE rank <= 2000"""
