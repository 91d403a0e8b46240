"""Queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import fingerprint, jaccard_join, language_id, lm_score, mixing, quality_model, quality_rules, sentencepiece_bpe, token_count, url_filter
from tidemark.llm.durable import save
from tidemark.llm.session import settle


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return settle(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def _held_out(n: int, fold: int) -> Column:
    """Whether a document is in the fold; one without an id is not."""
    return F.coalesce(_fold(n) == fold, F.lit(False)).alias("held_out")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text edited with the next document's."""
    return fingerprint.edited_pairs(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, probability and draw of every document, for tempered source, language and topic margins."""
    rows = mixing.with_topics(_table(spark, sf_dir, "documents"), [F.col("doc_id"), F.col("lang"), F.col("source")])
    return mixing.mix(save(rows, "mix-rows"), MIX_DIMS)


MIX_DIMS = ["source", "lang", "topic"]
MIX_ROUNDS, MIX_POWER = 8, 0.7


def mixing_sql() -> str:
    """The same fit, one common table a margin and round."""
    steps = [
        r"rows AS (SELECT row_number() OVER () AS r, doc_id, lang, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)",
        "df AS (SELECT w, count(*) AS n FROM (SELECT unnest(list_distinct(ws)) AS w FROM rows) GROUP BY w)",
        f"anchors AS (SELECT w, k FROM (SELECT w, row_number() OVER (ORDER BY n DESC, w) AS k FROM df WHERE 10 * n <= (SELECT count(*) FROM rows)) WHERE k <= {mixing.TOPICS})",
        "hits AS (SELECT r, w, k, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM rows) JOIN anchors USING (w) GROUP BY r, w, k)",
        "best AS (SELECT r, arg_max(w, n * 1000 - k) AS topic FROM hits GROUP BY r)",
        "docs AS (SELECT doc_id, lang, source, len(ws) AS n_tokens, coalesce(topic, 'other') AS topic FROM rows LEFT JOIN best USING (r))",
        "cells AS (SELECT coalesce(source, '') AS source, coalesce(lang, '') AS lang, topic, sum(n_tokens) AS tokens FROM docs GROUP BY ALL)",
    ]
    for d in MIX_DIMS:
        steps.append(f"raw_{d} AS (SELECT {d}, pow(CAST(sum(tokens) AS DOUBLE), {MIX_POWER}) AS raw FROM cells GROUP BY {d})")
        steps.append(f"t_{d} AS (SELECT {d}, raw / sum(raw) OVER () AS share FROM raw_{d})")
    shares = ", ".join(f"t_{d}.share AS s_{d}" for d in MIX_DIMS)
    joins = " ".join(f"JOIN t_{d} USING ({d})" for d in MIX_DIMS)
    steps.append(f"f0 AS (SELECT cells.*, {shares}, CAST(tokens AS DOUBLE) AS weight FROM cells {joins})")
    n = 0
    for _ in range(MIX_ROUNDS):
        for d in MIX_DIMS:
            steps.append(f"f{n + 1} AS MATERIALIZED (SELECT * EXCLUDE (weight), weight * s_{d} / sum(weight) OVER (PARTITION BY {d}) AS weight FROM f{n})")
            n += 1
    steps.append(
        f"fit AS (SELECT source, lang, topic, round(weight / tokens * (SELECT sum(tokens) FROM f{n}), 9) AS weight,"
        f" round(weight / tokens / (SELECT max(weight / tokens) FROM f{n}), 9) AS probability FROM f{n})"
    )
    return "WITH " + ",\n".join(steps) + """
SELECT d.doc_id, d.lang, d.source, d.topic, d.n_tokens, f.weight, f.probability,
  CAST(('0x' || substr(sha256('mix:' || CAST(d.doc_id AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0 < f.probability AS selected
FROM docs d JOIN fit f ON f.source = coalesce(d.source, '') AND f.lang = coalesce(d.lang, '') AND f.topic = d.topic"""


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality_rules.judge(_table(spark, sf_dir, "documents"), [F.col("doc_id")])


def quality_rules_sql(prior: int = 100, spread: float = 3.0) -> str:
    """The same counts and fences; quartiles are read from the histograms by a running sum."""
    values = {m: e.replace(" div ", " // ") for m, (e, _, _) in quality_rules.METRICS.items()}
    metrics = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {e} AS v FROM measured WHERE NOT base_failed" for m, e in values.items())

    def quartiles(cells: str, keys: str) -> str:
        on = f"PARTITION BY {keys}metric"
        running = f"SELECT *, sum(n) OVER ({on} ORDER BY bin) AS run, sum(n) OVER ({on}) AS rows_ FROM {cells}"
        return f"SELECT {keys}metric, any_value(rows_) AS rows_, min(bin) FILTER (WHERE 4 * run >= rows_) AS q1, min(bin) FILTER (WHERE 4 * run >= 3 * rows_) AS q3 FROM ({running}) GROUP BY ALL"

    drawn = lambda t, own, to: f"(CAST({t}.rows_ AS DOUBLE) * CAST({own} AS DOUBLE) + {prior}::DOUBLE * {to}) / (CAST({t}.rows_ AS DOUBLE) + {prior}::DOUBLE)"
    pick = lambda q: drawn("s", f"s.{q}", "(" + drawn("l", f"l.{q}", f"CAST(w.{q} AS DOUBLE)") + ")") + f" AS {q}"
    tests = []
    for m, (_, lower, least) in quality_rules.METRICS.items():
        wide = f"greatest(q3 - q1, {least}) * {spread}"
        low = f"q1 - {wide}" if lower else "-1.0"
        tests.append(f"coalesce(({values[m]}) BETWEEN (SELECT {low} FROM fences f WHERE f.metric = '{m}' AND {{same}}) AND (SELECT q3 + {wide} FROM fences f WHERE f.metric = '{m}' AND {{same}}), false)")
    within = " AND ".join(tests).format(same="f.lang IS NOT DISTINCT FROM c.lang AND f.source IS NOT DISTINCT FROM c.source")
    return rf"""WITH texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
lines AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM texts),
starts AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM texts WHERE len(ws) >= 3),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM starts),
spots AS (SELECT DISTINCT doc_id, i + k AS i FROM win, (VALUES (0), (1), (2)) AS o(k) WHERE n >= 2),
again AS (SELECT doc_id, count(*) AS n FROM spots GROUP BY doc_id),
counts AS (SELECT l.doc_id, l.lang, l.source, len(ws) AS n_words, length(coalesce(list_aggregate(ws, 'string_agg', ''), '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(a.n, 0) AS n_repeat_words FROM lines l LEFT JOIN again a ON a.doc_id = l.doc_id),
measured AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
vals AS ({metrics}),
cells AS (SELECT lang, source, metric, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS bin, count(*) AS n FROM vals GROUP BY ALL),
by_lang AS (SELECT lang, metric, bin, sum(n) AS n FROM cells GROUP BY ALL), whole AS (SELECT metric, bin, sum(n) AS n FROM cells GROUP BY ALL),
qs AS ({quartiles("cells", "lang, source, ")}), ql AS ({quartiles("by_lang", "lang, ")}), qw AS ({quartiles("whole", "")}),
fences AS (SELECT s.lang, s.source, s.metric, {pick("q1")}, {pick("q3")} FROM qs s JOIN ql l ON l.lang IS NOT DISTINCT FROM s.lang AND l.metric = s.metric JOIN qw w ON w.metric = s.metric)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {within} AS kept FROM measured c"""


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score and model score of every document, learned from those whose fold is not 1."""
    docs = _table(spark, sf_dir, "documents")
    model, counts = lm_score.train(docs, _fold(5) != 1)
    return lm_score.score(docs, model, counts, [F.col("doc_id"), _held_out(5, 1)])


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels whose fold is not 1."""
    docs = _table(spark, sf_dir, "documents")
    model = quality_model.fit(docs, _table(spark, sf_dir, "labels"), _fold(3) != 1)
    return quality_model.score(docs, model, [F.col("doc_id"), _held_out(3, 1)])


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return sentencepiece_bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


#: Rules of the URL query, and the names whose hosts are on its list under each ending.
URL_RULES = ["block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/"]
LISTED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED_URLS = [f"{name}.example.{ending}/" for name in LISTED_NAMES for ending in ("com", "net", "org")]


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The made-up part of the list that grows with the pages: the canonical URLs whose digest begins with 0, one in sixteen."""
    host, path = url_filter.canonical(*url_filter.host_and_path(F.col("url")))
    urls = _table(spark, sf_dir, "pages").select(host.alias("host"), path.alias("path")).where("host <> '' and startswith(md5(concat(host, path)), '0')").distinct()
    return urls.select("host", "path", F.lit("block").alias("action"), F.lit(False).alias("is_rule"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    listed = url_filter.listing(spark, URL_RULES, [("block", key) for key in LISTED_URLS]).unionByName(_reported(spark, sf_dir))
    return url_filter.judge(_table(spark, sf_dir, "pages"), listed)


#: As it was when the query blocked ``net/de/``, which its contract allows: here the SQL still differs from ``URL_RULES``.
_RULE_ROWS = "('com', 'en/', 'block'), ('example.com', 'en/7', 'allow'), ('net', 'de/', 'block'), ('example.net', 'de/8', 'block'), ('org', 'es/', 'block')"
_LIST_ROWS = ", ".join(f"('{key[:-1]}', '/')" for key in LISTED_URLS)
URL_SQL = f"""
WITH rules(host, path, action) AS (SELECT host, '/' || path, action FROM (VALUES {_RULE_ROWS}) AS r(host, path, action)),
cut AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id, row_number() OVER () AS n,
  coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
canon AS (SELECT *, regexp_replace(regexp_replace(host, ':(80|443)?$', ''), '[.]$', '') AS ch, CASE WHEN path = '' THEN '/' ELSE regexp_replace(url_decode(replace(path, '+', '%2B')), '/+', '/', 'g') END AS cp FROM parts),
listed AS (SELECT host, path FROM (VALUES {_LIST_ROWS}) AS l(host, path) UNION SELECT ch, cp FROM canon WHERE ch <> '' AND starts_with(md5(ch || cp), '0')),
fits AS (SELECT p.n, r.host || r.path AS rule, r.action, row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC) AS k
  FROM parts p JOIN rules r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path)),
hits AS (SELECT DISTINCT p.n FROM canon p JOIN listed l ON (p.ch = l.host OR p.ch LIKE '%.' || l.host) AND (p.cp = l.path OR starts_with(p.cp, rtrim(l.path, '/') || '/')))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, CASE WHEN h.n IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.n = p.n AND f.k = 1 LEFT JOIN hits h ON h.n = p.n
"""


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose four-word shingles agree to 85 per cent."""
    return jaccard_join.join(_table(spark, sf_dir, "documents"), k=4, percent=85)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose fold is not 0."""
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, _fold(5) != 0, [F.col("doc_id"), _held_out(5, 0)])


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE tokens of every document."""
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_mixing": op2_mixing,
    "op3_quality_rules": op3_quality_rules,
    "op4_lm_score": op4_lm_score,
    "op5_quality_model": op5_quality_model,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_url_filter": op7_url_filter,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_language": op9_language,
    "op10_token_counts": op10_token_counts,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": mixing_sql(),
    "op3_quality_rules": quality_rules_sql(),
    "op7_url_filter": URL_SQL,
}
