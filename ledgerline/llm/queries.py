"""The registered queries of this subpackage and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.common import read_table
from ledgerline.llm.decontamination import contamination
from ledgerline.llm.embedding_dedup import near_vectors
from ledgerline.llm.filter_audit import audit_filters
from ledgerline.llm.packing import pack_documents
from ledgerline.llm.pii import find_personal_data
from ledgerline.llm.quality_rules import MEASURES, assess
from ledgerline.llm.secret_scan import scan_secrets
from ledgerline.llm.simhash import near_duplicates
from ledgerline.llm.source_divergence import divergence
from ledgerline.llm.substring_dedup import dedup_substrings
from ledgerline.llm.suffix_dedup import dedup_suffixes
from ledgerline.llm.token_counts import token_counts
from ledgerline.llm.toxicity import score_documents


def _documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", "doc_id", "text", *more)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_documents(spark, sf_dir)).drop("kept_text")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_documents(spark, sf_dir)).drop("found")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels", "doc_id", "toxic")
    return score_documents(_documents(spark, sf_dir), labels)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(_documents(spark, sf_dir)).drop("kept_bytes")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(_documents(spark, sf_dir, "lang", "source")).drop(*(m.name for m in MEASURES))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_documents(spark, sf_dir)).drop("found")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = read_table(spark, sf_dir, "benchmark", "item_id", "text")
    return contamination(_documents(spark, sf_dir), benchmark).drop("items", "spans")


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return audit_filters(_documents(spark, sf_dir, "lang"), labels)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read_table(spark, sf_dir, "documents", "text", "lang", "source"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_substring_dedup,
        op2_simhash_dedup,
        op3_secret_scan,
        op4_toxicity,
        op5_token_counts,
        op6_suffix_dedup,
        op7_best_fit_packing,
        op8_quality_rules,
        op9_personal_data,
        op10_decontamination,
        op11_embedding_dedup,
        op12_filter_audit,
        op13_source_divergence,
    )
    return {query.__name__: query for query in named}


OP1_SQL = r"""
WITH docs AS (
    SELECT doc_id, coalesce(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''), []) AS w
    FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS gram
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)
), firsts AS (
    SELECT gram, min(doc_id) AS smallest FROM windows GROUP BY gram
), gone AS (
    SELECT doc_id, list(DISTINCT place) AS places
    FROM (SELECT doc_id, unnest(range(i, i + 13)) AS place
          FROM windows JOIN firsts USING (gram) WHERE doc_id > smallest)
    GROUP BY doc_id
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text
    FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM docs)
    WHERE NOT EXISTS (
        SELECT 1 FROM (SELECT doc_id AS d, unnest(places) AS p FROM gone) g WHERE g.d = doc_id AND g.p = place)
    GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(len(g.places), 0)::BIGINT AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN gone g USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

OP10_SQL = r"""
WITH items AS (
    SELECT DISTINCT item_id, list_filter(string_split_regex(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
    FROM benchmark
), patterns AS (
    SELECT item_id, least(len(w), 13) AS n,
           unnest(list_transform(range(1, greatest(1, len(w) - 12) + 1),
                                 lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS window
    FROM items WHERE len(w) > 0
), docs AS (
    SELECT doc_id, list_filter(string_split_regex(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
    FROM documents
), sizes AS (
    SELECT DISTINCT n FROM patterns
), windows AS (
    SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w
    FROM docs, sizes WHERE len(w) >= n
), hits AS (
    SELECT d.doc_id, d.i, d.n, p.item_id
    FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS window FROM windows) d
    JOIN patterns p ON p.n = d.n AND p.window = d.window
), marked AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id
), listed AS (
    SELECT doc_id, count(*) AS n_items,
           sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS digest
    FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(m.n_hit, 0)::BIGINT AS n_hit,
       coalesce(l.n_items, 0)::BIGINT AS n_items, coalesce(l.digest, sha256('')) AS items_sha256,
       coalesce(m.n_hit > 0 AND 20 * m.n_hit >= len(d.w), false) AS contaminated
FROM docs d LEFT JOIN marked m USING (doc_id) LEFT JOIN listed l USING (doc_id)
"""


OP11_SQL = r"""
WITH RECURSIVE rows AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), usable AS (
    SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size
    FROM rows
    WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.9
), reached AS (
    SELECT vec_id AS a, vec_id AS b FROM rows
    UNION
    SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), components AS (
    SELECT a, min(b) AS component_id FROM reached GROUP BY a
), counts AS (
    SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT r.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, r.vec_id = c.component_id AS kept
FROM rows r JOIN components c ON c.a = r.vec_id LEFT JOIN counts n ON n.a = r.vec_id
"""

OP12_SQL = r"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body FROM documents
), measured AS (
    SELECT doc_id, part, body,
           list_filter(string_split_regex(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM texts
), failed AS (
    SELECT doc_id, part,
           len(w) < 100 AS a,
           100 * len(list_distinct(w)) < 80 * len(w) AS b,
           100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 10 * length(body) AS c,
           regexp_matches(body, '[#$%&*|]') AS d,
           doc_id > min(doc_id) OVER (PARTITION BY body) AS e
    FROM measured
), masks AS (
    SELECT f.part, f.a::INT + 2 * f.b::INT + 4 * f.c::INT + 8 * f.d::INT + 16 * f.e::INT AS mask,
           coalesce(l.quality = 1, false)::INT AS good, coalesce(l.toxic = 1, false)::INT AS toxic
    FROM failed f LEFT JOIN labels l USING (doc_id)
), counts AS (
    SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
    SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order,
           unnest([1, 2, 3, 4, 5]) AS step,
           unnest([p.bit, q.bit, r.bit, s.bit, t.bit]) AS bit,
           unnest([0, p.bit, p.bit + q.bit, p.bit + q.bit + r.bit, 31 - t.bit]) AS before
    FROM letters p, letters q, letters r, letters s, letters t
    WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31
), steps AS (
    SELECT part, filter_order, step, bit,
           sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
           sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
           sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
           sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
           sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
           sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM counts, orders GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM steps
"""

OP13_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS nr, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           coalesce(text, '') AS body
    FROM documents
), found AS (
    SELECT nr, lang, source, unnest(list_filter(string_split_regex(
        translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term
    FROM docs
), kept AS (
    SELECT lang, term, count(*) AS n FROM found GROUP BY lang, term HAVING count(DISTINCT nr) >= 3
), langs AS (
    SELECT g.lang, count(k.term) AS v, coalesce(sum(k.n), 0) AS total
    FROM (SELECT DISTINCT lang FROM docs) g LEFT JOIN kept k USING (lang) GROUP BY g.lang
), counted AS (
    SELECT f.lang, f.source, f.term, count(*) AS n FROM found f JOIN kept k USING (lang, term)
    GROUP BY f.lang, f.source, f.term
), groups AS (
    SELECT g.lang, g.source, l.v, coalesce(sum(c.n), 0) AS total
    FROM (SELECT DISTINCT lang, source FROM docs) g JOIN langs l USING (lang)
    LEFT JOIN counted c USING (lang, source) GROUP BY g.lang, g.source, l.v
), shares AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
           (1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.total + g.v))::HUGEINT AS p,
           (1 + (1000000000 * (k.n + 1)) // (l.total + l.v))::HUGEINT AS q
    FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang)
    LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, s.value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (
        SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
        FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
        GROUP BY x.lang, x.source, y.source
    ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
    SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value
    FROM shares WHERE n > 0 AND p > q
), ranked AS (
    SELECT lang, source, part, item, coalesce(value, 0)::BIGINT AS value,
           row_number() OVER (PARTITION BY lang, source, part ORDER BY coalesce(value, 0) DESC, item)::INT AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": OP1_SQL,
        "op10_decontamination": OP10_SQL,
        "op11_embedding_dedup": OP11_SQL,
        "op12_filter_audit": OP12_SQL,
        "op13_source_divergence": OP13_SQL,
    }
