"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.llm import (
    alignment,
    decontaminate,
    exact,
    kneser_ney,
    language,
    licenses,
    neighbours,
    packing,
    phrases,
    pii,
    quality,
    simhash,
    variants,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql.strip()
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


#: DuckDB: lower-cases A-Z alone.
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op1_substring_dedup", r"""
    WITH words AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    windows AS (
      SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS t
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)),
    repeated AS (SELECT t FROM windows GROUP BY t HAVING count(*) > 1),
    covered AS (
      SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM windows JOIN repeated USING (t))),
    placed AS (
      SELECT doc_id, p, word, c.p IS NULL AS stays
      FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words) LEFT JOIN covered c USING (doc_id, p)),
    kept AS (
      SELECT doc_id, count(*) FILTER (NOT stays) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (stays) AS t
      FROM placed GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM words LEFT JOIN kept USING (doc_id)
""")
def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = phrases.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_exact_dedup", f"""
    WITH lowered AS (SELECT doc_id, {LOWERED} AS t FROM documents),
    groups AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM lowered GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
    FROM lowered JOIN groups USING (t)
""")
def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(table(spark, folder, "documents"))


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query("op9_lm_scoring")
def op9_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return kneser_ney.score_held_out(table(spark, folder, "documents"))


@query("op10_simhash_near_dedup")
def op10_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(table(spark, folder, "documents"))


@query("op4_pii")
def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.scan(table(spark, folder, "documents"))


#: Literal wording of the templates: number, label, notice, key phrase, whether it is a base phrase.
_LICENSES = """
    (0, 'mit', 'released under the mit license', 'under the mit license', true),
    (1, 'apache-2', 'licensed under the apache license version 2 0', 'apache license version 2', true),
    (2, 'cc-by-nc', 'licensed under cc by nc 4 0', 'cc by nc', true),
    (3, 'gpl-3', 'licensed under the gnu general public license version 3', 'gnu general public license version 3', false),
    (4, 'gpl-2', 'licensed under the gnu general public license version 2', 'gnu general public license version 2', false),
    (5, 'lgpl', 'licensed under the gnu lesser general public license', 'gnu lesser general public license', false),
    (6, 'agpl-3', 'licensed under the gnu affero general public license', 'gnu affero general public license', false),
    (7, 'mpl-2', 'subject to the terms of the mozilla public license v 2 0', 'mozilla public license', false),
    (8, 'cc-by-sa', 'licensed under cc by sa 4 0', 'cc by sa', false),
    (9, 'cc0', 'dedicated to the public domain under cc0 1 0', 'public domain under cc0', false),
    (10, 'mit', 'permission is hereby granted free of charge to any person obtaining a copy of this software',
     'permission is hereby granted free of charge', false),
    (11, 'bsd', 'redistribution and use in source and binary forms with or without modification are permitted',
     'redistribution and use in source and binary forms', false),
    (12, 'unlicense', 'this is free and unencumbered software released into the public domain',
     'free and unencumbered software', false)"""


@query("op5_license_scan", rf"""
    WITH words AS (
      SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    templates(k, label, notice, phrase, base) AS (VALUES {_LICENSES}),
    spelt AS (
      SELECT k, label, base, string_split(notice, ' ') AS notice, string_split(phrase, ' ') AS phrase,
             len(string_split(split_part(' ' || notice || ' ', ' ' || phrase || ' ', 1), ' ')) - 1 AS lead FROM templates),
    postings AS (SELECT k, unnest(notice) AS word, unnest(range(len(notice))) AS p FROM spelt),
    weights AS (
      SELECT word, ln(((SELECT count(*) FROM words) + 1) / ((SELECT count(*) FROM words WHERE list_contains(w, word)) + 1)) AS idf
      FROM (SELECT DISTINCT word FROM postings)),
    rare AS (
      SELECT k, p, word, idf FROM postings JOIN weights USING (word)
      QUALIFY row_number() OVER (PARTITION BY k ORDER BY idf DESC, p) <= 4),
    places AS (
      SELECT doc_id, w, s.k, label, base, lead, unnest(list_filter(range(len(w) - len(phrase) + 1),
             lambda i: w[i + 1 : i + len(phrase)] = phrase)) AS start
      FROM words, spelt s WHERE list_contains(w, phrase[len(phrase)]) AND list_contains(w, phrase[1])),
    supported AS (
      SELECT doc_id, k, label, base, start,
             CASE WHEN sum(idf) > 0 THEN sum(CASE WHEN start - lead + p >= 0 AND w[start - lead + p + 1] = word THEN idf ELSE 0 END) / sum(idf)
                  ELSE 1 END AS support
      FROM places JOIN rare USING (k) GROUP BY ALL),
    told AS (SELECT * FROM supported WHERE base OR support >= 0.5),
    summed AS (
      SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(support) AS score
      FROM told GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
           round(coalesce(score, 0), 6)::DOUBLE AS score
    FROM words LEFT JOIN summed USING (doc_id)
""")
def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents"))
    return found.withColumn("score", F.round("score", 6))


@query("op6_benchmark_decontamination")
def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaked_pairs(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


@query("op11_spelling_variants", r"""
    WITH RECURSIVE crc AS MATERIALIZED (
      SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
             lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    lowered AS (
      SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r
      FROM documents),
    spelt AS (
      SELECT r, count(*) AS m, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS x FROM lowered GROUP BY doc_id, r),
    octets AS (
      SELECT r, m, list_transform(range(len(x) // 2), lambda i: (strpos('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1) * 16
             + strpos('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1) AS b FROM spelt),
    hashed AS MATERIALIZED (
      SELECT r, m, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8)), 4294967295) AS h
      FROM octets, crc),
    words AS MATERIALIZED (
      SELECT w AS word, sum(m)::BIGINT AS n
      FROM (SELECT m, CASE WHEN h % 97 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS w FROM hashed)
      WHERE length(w) >= 5 GROUP BY w HAVING sum(m) >= 3),
    without AS (
      SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
      FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
    near AS (
      SELECT a.word, b.word AS other FROM without a JOIN without b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT a.word, b.word FROM without a JOIN words b ON a.rest = b.word
      UNION SELECT b.word, a.word FROM without a JOIN words b ON a.rest = b.word),
    best AS (
      SELECT near.word, count(*) AS n_near, arg_min(other, (-n, other)) AS form, max(n) AS form_n
      FROM near JOIN words ON other = words.word GROUP BY 1),
    forms AS MATERIALIZED (
      SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form,
             CASE WHEN form_n >= 2 * n THEN form_n END AS form_n
      FROM words LEFT JOIN best USING (word)),
    chains(word, here, next) AS (
      SELECT word, word, form FROM forms
      UNION ALL SELECT chains.word, chains.next, forms.form FROM chains JOIN forms ON chains.next = forms.word)
    SELECT word, form, chains.here AS root, n, n_near, form_n FROM forms JOIN chains USING (word) WHERE chains.next IS NULL
""")
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.spelling_variants(table(spark, folder, "documents"))


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align_tokens(table(spark, folder, "documents"))


@query("op13_nearest_neighbours", """
    WITH sound AS (
      SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
      WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    pairs AS (
      SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(
             range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])), lambda a, b: a + b)) AS score
      FROM sound q JOIN sound c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score
    FROM pairs QUALIFY rank <= 10
""")
def op13_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, folder, "embeddings"))
