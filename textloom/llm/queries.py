"""The queries of the training-data operators: op<N>_<name>(spark, sf_dir), over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common
from textloom.llm.decontaminate import matches
from textloom.llm.langid import identify
from textloom.llm.license_scan import scan_licenses
from textloom.llm.line_dedup import dedup_lines
from textloom.llm.mixing import plan, with_copies, word_count
from textloom.llm.quality_rules import GRIDS, SYMBOLS, apply_cutoffs, choose_cutoffs, measures
from textloom.llm.simhash import near_duplicates
from textloom.llm.token_count import token_counts
from textloom.llm.token_output import read_token_ids, write_token_ids
from textloom.llm.url_filter import PATTERNS, host_path_rule, judge

URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
MIX_ENTROPY = 0.95
VOCABULARY = "word_bpe_49k.json"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.array_join("removed_lines", ",").alias("removed_lines"), F.md5(F.col("clean_text").cast("binary")).alias("clean_md5"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    mix = plan(docs, word_count(F.col("text")), target_entropy=MIX_ENTROPY)
    return with_copies(docs.select("doc_id", "source"), mix).select("doc_id", "source", F.round("weight", 6).alias("weight"), "copies", "block_rank", F.round("first_place", 6).alias("first_place"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [host_path_rule(rule, verdict) for rule, verdict in URL_RULES]
    return judge(common.table(spark, sf_dir, "pages"), [*rules, *PATTERNS]).select("page_id", "host", "path", "rule", "verdict")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(common.table(spark, sf_dir, "documents"))
    named = F.filter("notices", lambda n: n["confirmed"])
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("notices").cast("long").alias("n_anchored"),
        F.size(named).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(named, lambda n: n["family"]))), ",").alias("families"),
        F.round(F.array_max(F.transform(named, lambda n: n["probability"])), 4).alias("probability"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = common.materialize(measures(common.table(spark, sf_dir, "documents"), stratum_col="lang"), "measures")
    judged = apply_cutoffs(measured, choose_cutoffs(measured, common.table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_token_ids(common.table(spark, sf_dir, "documents"), common.shared_path(spark, "token-ids"), public_tokenizers.path(VOCABULARY))
    return read_token_ids(spark, path, content="crc")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_simhash": op2_simhash,
    "op3_language_id": op3_language_id,
    "op4_source_mixing": op4_source_mixing,
    "op5_url_filters": op5_url_filters,
    "op6_token_counts": op6_token_counts,
    "op7_decontamination": op7_decontamination,
    "op8_license_scan": op8_license_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_output": op10_token_output,
}
OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
worded AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS k FROM lines
  WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
three AS (
  SELECT doc_id, pos, k, lead(k) OVER o AS k2, lead(k, 2) OVER o AS k3, lead(pos) OVER o AS pos2, lead(pos, 2) OVER o AS pos3 FROM worded
  WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, k2, k3 ORDER BY doc_id, pos) AS rn FROM three WHERE k3 IS NOT NULL) WHERE rn > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest([pos, pos2, pos3]) AS pos FROM later),
marked AS (
  SELECT l.*, g.pos IS NOT NULL AS out FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (out) AS n_removed,
  coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (out), '') AS removed_lines,
  md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT out), '')) AS clean_md5
FROM marked GROUP BY doc_id
"""

OP4_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, source, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS tokens,
    ('0x' || left(md5('block0|' || doc_id), 8))::BIGINT % 1024 AS block FROM documents),
cells AS (SELECT source, block, sum(tokens) AS tokens FROM words GROUP BY ALL),
sizes AS (SELECT source, sum(tokens)::DOUBLE AS tokens FROM cells GROUP BY ALL),
shares AS (SELECT list(tokens / total) AS p, any_value(total) AS total FROM sizes, (SELECT sum(tokens) AS total FROM sizes)),
search(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END FROM (
    SELECT step, low, high, mid, ln(z) - mid * s / z >= {MIX_ENTROPY} * ln(len(p)) - 1e-12 AS ok FROM (
      SELECT step, low, high, p, mid, list_sum(list_transform(p, lambda x: pow(x, mid))) AS z, list_sum(list_transform(p, lambda x: pow(x, mid) * ln(x))) AS s
      FROM (SELECT step, low, high, CASE WHEN step = 0 THEN 1.0::DOUBLE ELSE (low + high) / 2 END AS mid, p FROM search, shares WHERE step < 60)))),
chosen AS (SELECT low AS a FROM search ORDER BY step DESC LIMIT 1),
weights AS (
  SELECT source, tokens, pow(tokens / total, a) / list_sum(list_transform(p, lambda x: pow(x, a))) AS weight, total FROM sizes, shares, chosen),
quotas AS (SELECT *, floor(weight * total / tokens + 1e-9) AS epochs FROM weights),
ranked AS (
  SELECT source, block, row_number() OVER o - 1 AS block_rank, sum(tokens) OVER o - tokens / 2 AS upto FROM cells
  WINDOW o AS (PARTITION BY source ORDER BY md5('order0|' || source || '|' || block)[:8], block)),
taken AS (
  SELECT r.source, r.block, r.block_rank, r.upto / (q.weight * q.total) AS place, q.weight, q.epochs + CASE WHEN q.weight * q.total - q.epochs * q.tokens > 0 AND r.upto <= q.weight * q.total - q.epochs * q.tokens THEN 1 ELSE 0 END AS copies
  FROM ranked r JOIN quotas q ON r.source = q.source)
SELECT w.doc_id, w.source, round(t.weight, 6) AS weight, t.copies::BIGINT AS copies, t.block_rank::BIGINT AS block_rank, round(t.place, 6) AS first_place
FROM words w JOIN taken t ON w.source = t.source AND w.block = t.block
"""

OP5_SQL = r"""
WITH cut AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rule, rule_host, rule_path, verdict) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
  ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
judged AS (
  SELECT c.*, (SELECT arg_max(r.rule, length(r.rule)) FROM rules r
    WHERE (c.host = r.rule_host OR ends_with(c.host, '.' || r.rule_host)) AND starts_with(c.path, r.rule_path)) AS rule
  FROM cut c)
SELECT page_id, host, path, j.rule,
  coalesce(r.verdict, CASE
    WHEN regexp_matches(host || path, '^([^/]*\.)?spam-farm\.') OR regexp_matches(host || path, '^([^/]*[.-])?(cheap|buy|online)-pills?[.-]')
      OR regexp_matches(host || path, '^([^/]*[.-])?casino[.-]') OR regexp_matches(host || path, '^([^/]*[.-])?(porn|xxx)[.-]')
      OR regexp_matches(host || path, '^([^/]*[.-])?(free|win)-(prizes?|money)[.-]') OR regexp_matches(host || path, '/(click|track)\.(php|cgi)$')
    THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN rules r ON j.rule = r.rule
""".replace("\\\\", "\\")



def op9_sql(false_rejection: float = 0.05, error: float = 0.05) -> str:
    """The quality query: measures, count table, exact binomial tails, fixed sequences and verdicts."""
    grid = ", ".join(f"('{rule}', {at}, {i}, {c}::DOUBLE)" for at, (rule, cutoffs) in enumerate(GRIDS.items()) for i, c in enumerate(cutoffs))
    return rf"""
WITH docs AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
windows AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM repeated) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
measured AS (
  SELECT w.doc_id, lang, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[{SYMBOLS}]')) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines,
    len(regexp_extract_all(t, '[A-Z]')) AS upper, len(regexp_extract_all(t, '[a-zA-Z]')) AS letters, len(regexp_extract_all(t, '!')) AS bangs
  FROM words w LEFT JOIN covered c ON w.doc_id = c.doc_id LEFT JOIN lines l ON w.doc_id = l.doc_id),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured),
ratios AS (
  SELECT *, n_symbols / greatest(n_words, 1) AS symbol_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_repeat_words / greatest(n_words, 1) AS repeat_ratio,
    upper / greatest(letters, 1) AS upper_ratio, bangs / greatest(n_words, 1) AS bang_ratio, word_chars / greatest(n_words, 1) AS long_words FROM based),
grid(rule, rule_at, i, cutoff) AS (VALUES {grid}),
valued AS (UNPIVOT (SELECT doc_id, lang, base_failed, symbol_ratio, dup_line_ratio, repeat_ratio, upper_ratio, bang_ratio, long_words FROM ratios)
  ON symbol_ratio, dup_line_ratio, repeat_ratio, upper_ratio, bang_ratio, long_words INTO NAME rule VALUE v),
cells AS (
  SELECT lang, rule, i, cutoff, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND v > cutoff) AS k, count(*) FILTER (quality = 0 AND v > cutoff) AS bad
  FROM valued JOIN labels USING (doc_id) JOIN grid USING (rule) WHERE NOT base_failed AND quality IS NOT NULL GROUP BY ALL),
tails AS (
  SELECT *, n > 0 AND list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(1 - p))))
      <= {error} / ((SELECT count(DISTINCT coalesce(lang, '')) FROM cells) * {len(GRIDS)}) AS safe
  FROM cells, (SELECT {false_rejection} / {len(GRIDS)} AS p)),
chosen AS (
  SELECT * FROM (SELECT *, bool_and(safe) OVER (PARTITION BY lang, rule ORDER BY i DESC) AS ok FROM tails) WHERE ok AND bad > k
  QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY bad - k DESC, i DESC) = 1),
failed AS (
  SELECT v.doc_id, string_agg(v.rule, ',' ORDER BY g.rule_at) AS rules FROM valued v JOIN chosen c ON v.lang IS NOT DISTINCT FROM c.lang AND v.rule = c.rule
  JOIN grid g ON g.rule = v.rule AND g.i = 0 WHERE v.v > c.cutoff GROUP BY v.doc_id)
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND f.rules IS NULL AS kept, coalesce(f.rules, '') AS failed_rules
FROM ratios r LEFT JOIN failed f ON r.doc_id = f.doc_id
"""


ORACLE_SQL: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op4_source_mixing": OP4_SQL, "op5_url_filters": OP5_SQL, "op9_quality_rules": op9_sql()}
