"""Registered queries: each operator over its whole table, with its SQL where
SQL can express it."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockline.llm.common import table
from dockline.llm.decontaminate import contamination, decontaminate
from dockline.llm.exact_dedup import exact_dedup
from dockline.llm.filter_audit import filter_audit
from dockline.llm.html_extract import extract
from dockline.llm.language_id import held_out, identify, learn
from dockline.llm.lexical_search import search
from dockline.llm.license_scan import scan, summary
from dockline.llm.line_dedup import drop_recurring
from dockline.llm.ngram_join import jaccard_components
from dockline.llm.packing import pack
from dockline.llm.sharding import assign_shards
from dockline.llm.simhash_dedup import simhash_components
from dockline.llm.token_counts import sentencepiece_pieces, token_counts


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return contamination(found)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = assign_shards(table(spark, sf_dir, "documents"))
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(scan(table(spark, sf_dir, "documents")))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"),
                        sentencepiece_pieces(public_tokenizers.path("piece_bpe_32k.model")))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_html_extract": op2_html_extract,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_sharding": op4_sharding,
    "op5_language_id": op5_language_id,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_ranked_search": op11_ranked_search,
    "op12_ngram_join": op12_ngram_join,
    "op13_filter_audit": op13_filter_audit,
}

#: Lower-cased words of a text, as a DuckDB list.
WORDS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
         r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

ORACLE = {
    "op1_decontaminate": f"""
        WITH item AS (SELECT item_id, {WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
        win AS (SELECT DISTINCT item_id, least(13, len(w)) AS k,
                       array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
                FROM item, unnest(range(1, greatest(len(w) - 13, 0) + 2)) t(i) WHERE len(w) > 0),
        doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce({WORDS}, []) AS w FROM documents),
        gram AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
                 FROM doc, (SELECT DISTINCT k FROM win), unnest(range(1, len(w) - k + 2)) t(i)),
        occ AS (SELECT r, i, k, item_id FROM gram JOIN win USING (k, g)),
        hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM occ, unnest(range(i, i + k)) t(p) GROUP BY r),
        its AS (SELECT r, list_sort(list_distinct(list(item_id::VARCHAR))) AS items FROM occ GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
               sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM doc LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
    """,
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_ranked_search": f"""
        WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents WHERE text IS NOT NULL),
        corpus AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM doc WHERE len(w) > 0),
        item AS (SELECT DISTINCT item_id, unnest({WORDS}) AS term FROM benchmark),
        tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM doc)
               WHERE term IN (SELECT term FROM item) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        part AS (SELECT term, r, doc_id, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT
                        * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))) AS score
                 FROM tf JOIN df USING (term), corpus),
        total AS (SELECT item_id, r, doc_id, sum(score)::BIGINT AS score
                  FROM item JOIN part USING (term) GROUP BY ALL HAVING sum(score) > 0)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
        FROM total QUALIFY rank <= 50
    """,
    "op12_ngram_join": r"""
        WITH RECURSIVE doc AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w FROM documents),
        gram AS (SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS g
                 FROM doc, unnest(range(1, greatest(len(w) - 3, 1) + 1)) t(i) WHERE len(w) > 0),
        size AS (SELECT r, count(*) AS n FROM gram GROUP BY r),
        pair AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM gram a JOIN gram b USING (g)
                 WHERE a.r <> b.r GROUP BY ALL),
        link AS (SELECT a, b FROM pair JOIN size x ON x.r = a JOIN size y ON y.r = b
                 WHERE 100 * common >= 85 * (x.n + y.n - common)),
        reach(r, m) AS (SELECT r, r FROM doc UNION SELECT reach.r, link.b FROM reach JOIN link ON reach.m = link.a)
        SELECT doc.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other.doc_id) AS component_id
        FROM reach JOIN doc USING (r) JOIN doc other ON other.r = reach.m LEFT JOIN size ON size.r = doc.r
        GROUP BY doc.r, doc.doc_id
    """,
    "op13_filter_audit": r"""
        WITH doc AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                            list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
                     FROM documents),
        label AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                         max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        fail AS (SELECT doc_id, part,
                        CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
                        || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
                        || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
                        || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
                        || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS m
                 FROM doc),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM f a, f b, f c, f d, f e
                   WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
        step AS (SELECT part, o, k::INTEGER AS step, substr(o, k, 1) AS f, contains(m, substr(o, k, 1)) AS fails,
                        translate(substr(o, 1, k - 1), m, '') <> substr(o, 1, k - 1) AS gone,
                        m = substr(o, k, 1) AS sole, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
                 FROM fail LEFT JOIN label USING (doc_id), orders, range(1, 6) r(k)),
        counted AS (SELECT part, o AS filter_order, step, f, count(*) FILTER (NOT fails AND NOT gone) AS kept,
                           count(*) FILTER (fails AND NOT gone) AS removed, count(*) FILTER (fails AND gone) AS redundant,
                           count(*) FILTER (sole) AS unique_fails,
                           count(*) FILTER (fails AND NOT gone AND good = 1) AS good_lost,
                           count(*) FILTER (fails AND NOT gone AND toxic = 1) AS toxic_lost
                    FROM step GROUP BY ALL)
        SELECT * EXCLUDE (f), sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM counted
    """,
}
