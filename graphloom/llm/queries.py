"""One query per corpus operator, over its whole table, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import chat, exact_dedup, hard_negatives, langid, line_dedup, mixing, ngram_join, packing, quality, toxicity, variants, warc, winnowing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.write(pages).lookup(warc.captures(pages))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', :said), (-7L, 1L, 'assistant', :said) AS t(conv_id, turn, role, text)", {"said": said}))
    back = chat.parsed(chat.format_conversations(chat.chains(rows)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "position")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compared(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.annotate(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0, label)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality.judge(docs, quality.train(docs, trusted))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_line_dedup, op2_ngram_join, op3_warc, op4_chat_format, op5_mix_sources, op6_language_id, op7_winnowing, op8_exact_dedup, op9_bin_packing, op10_toxicity, op11_spelling_variants, op12_hard_negatives, op13_quality_rules]
    return {f.__name__: f for f in found}


OP5_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM per),
weighed AS (SELECT *, 1 + rank % 3 AS weight, 3 * source_size AS cap FROM ranked),
filled AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spare,
         sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rivals
  FROM weighed),
judged AS (SELECT *, cap * rivals <= weight * spare AS is_full FROM filled),
targets AS (
  SELECT source, source_size, rank,
         CASE WHEN is_full THEN cap::DOUBLE
              ELSE weight * (sum(source_size) OVER () - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())::DOUBLE
                   / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () END AS target
  FROM judged),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.rank, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY t.rank ORDER BY s.place, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
took AS (
  SELECT *, (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
  FROM placed),
shared AS (
  SELECT *, CASE WHEN taken > 0 AND target > 0 THEN least((before + least(size, taken) / 2) / target, 1.0) END AS share
  FROM took)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN share IS NULL THEN NULL ELSE CASE rank % 3
         WHEN 1 THEN share
         WHEN 0 THEN CASE WHEN share < 0.625 THEN least(1.0, (sqrt(2.25 + share * -2.0) - 1.5) / -1.0)
                          ELSE least(1.0, 0.5 + (sqrt(1.0 + (share - 0.625) * -2.0) - 1.0) / -1.0) END
         ELSE CASE WHEN share < 0.375 THEN (sqrt(0.25 + share * 2.0) - 0.5) / 1.0
                   ELSE least(1.0, 0.5 + (sqrt(1.0 + (share - 0.375) * 2.0) - 1.0) / 1.0) END
       END END AS position
FROM shared
"""

OP8_SQL = r"""
WITH digests AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
grouped AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM digests WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM grouped
"""


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
windows AS (
  SELECT doc_id, i AS pos, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS w
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM lines)),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS n FROM windows),
marked AS (SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS line FROM ranked WHERE n > 1),
each_line AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS line FROM lines),
kept AS (
  SELECT e.doc_id, coalesce(string_agg(e.l[e.line], chr(10) ORDER BY e.line) FILTER (WHERE m.line IS NULL), '') AS text,
         count(*) AS n_lines, count(m.line) AS n_removed
  FROM each_line e LEFT JOIN marked m ON e.doc_id = m.doc_id AND e.line = m.line GROUP BY e.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(text) AS text_sha256 FROM kept
"""

OP3_SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM w
"""

OP4_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'))
          + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;')) + 12 AS size
  FROM rows),
grouped AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, sum(size)::BIGINT AS formatted_chars
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM grouped
"""


OP11_SQL = r"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i::BIGINT, 0, i::BIGINT FROM range(256) AS r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS by_byte FROM bits WHERE k = 8),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
counted AS (SELECT id, run, count(*) AS times FROM runs WHERE length(run) >= 6 GROUP BY ALL),
spelled AS (
  SELECT run, times, by_byte, flatten(list_transform(string_split(id || ':' || run, ''),
         lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c)::BIGINT >> 6), 128 + (unicode(c)::BIGINT & 63)] END)) AS bytes
  FROM counted, crc_table),
hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, b: xor(a >> 8, by_byte[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM spelled),
typed AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, times
  FROM hashed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM typed WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
shorter AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT s.word, w.word FROM shorter s JOIN words w ON s.rest = w.word
  UNION SELECT w.word, s.word FROM shorter s JOIN words w ON s.rest = w.word),
near_rows AS (
  SELECT p.word, count(*) AS n_near FROM pairs p GROUP BY p.word),
best AS (
  SELECT p.word, p.near AS form, f.n AS form_n FROM pairs p JOIN words w ON p.word = w.word JOIN words f ON p.near = f.word
  WHERE f.n >= 5 * w.n QUALIFY row_number() OVER (PARTITION BY p.word ORDER BY f.n DESC, p.near) = 1),
chains(word, reached, steps) AS (
  SELECT word, word, 0 FROM words
  UNION ALL SELECT c.word, b.form, c.steps + 1 FROM chains c JOIN best b ON c.reached = b.word),
ends AS (SELECT word, max_by(reached, steps) AS root FROM chains GROUP BY word)
SELECT w.word, b.form, e.root, w.n, coalesce(r.n_near, 0)::BIGINT AS n_near, b.form_n
FROM words w LEFT JOIN best b ON w.word = b.word LEFT JOIN near_rows r ON w.word = r.word JOIN ends e ON w.word = e.word
"""

OP12_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, list_inner_product(a.x, c.x)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 10
"""

OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS trusted
  FROM documents),
places AS (SELECT row, w, unnest(range(1, len(w) - 6)) AS i FROM d),
windows AS (SELECT row, i, array_to_string(w[i:i + 7], ' ') AS win FROM places),
again AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, win) > 1),
covered AS (SELECT row, count(DISTINCT i + k) AS n_repeat_words FROM again, range(8) AS r(k) GROUP BY row),
lines AS (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT row, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
spaced AS (SELECT row, trusted, string_split(' ' || array_to_string(w, ' ') || ' ', '') AS c FROM d WHERE len(w) > 0),
chars AS (SELECT row, trusted, unnest(list_transform(c, lambda x: unicode(x)::BIGINT)) AS a, unnest(range(1, len(c) + 1)) AS i FROM spaced),
grams AS (
  SELECT row, trusted, ((a * 1000003 + lead(a) OVER (PARTITION BY row ORDER BY i)) * 1000003 + lead(a, 2) OVER (PARTITION BY row ORDER BY i)) % 2147483647 % 65536 AS bucket
  FROM chars),
per AS (SELECT row, trusted, bucket, count(*) AS n FROM grams WHERE bucket IS NOT NULL GROUP BY ALL),
totals AS (SELECT sum(n) AS raw, coalesce(sum(n) FILTER (WHERE trusted), 0) AS target FROM per),
weights AS (
  SELECT bucket, CASE WHEN t.target = 0 THEN 0 ELSE round(1000 * ln(((coalesce(sum(n) FILTER (WHERE trusted), 0) + 1)::DOUBLE / (t.target + 65536)::DOUBLE) / ((sum(n) + 1)::DOUBLE / (t.raw + 65536)::DOUBLE)))::BIGINT END AS weight
  FROM per, totals t GROUP BY bucket, t.raw, t.target),
ratio AS (SELECT row, sum(n)::BIGINT AS n_grams, sum(n * weight)::BIGINT AS ratio_sum FROM per JOIN weights USING (bucket) GROUP BY row),
counts AS (
  SELECT row, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols
  FROM d),
judged AS (
  SELECT c.*, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words AS base_failed,
         coalesce(n_grams, 0)::BIGINT AS n_grams, coalesce(ratio_sum, 0)::BIGINT AS ratio_sum
  FROM counts c LEFT JOIN dup USING (row) LEFT JOIN covered USING (row) LEFT JOIN ratio USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ratio_sum >= -300 * n_grams AS kept, n_grams, ratio_sum
FROM judged
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_spelling_variants": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_quality_rules": OP13_SQL, "op1_line_dedup": OP1_SQL, "op3_warc": OP3_SQL, "op4_chat_format": OP4_SQL, "op5_mix_sources": OP5_SQL, "op8_exact_dedup": OP8_SQL}
