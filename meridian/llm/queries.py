"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.session import shared_folder

from .best_fit_packing import best_fit_packing
from .common import table
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_components
from .line_crf import crf_quality
from .merkle_manifest import merkle_manifest
from .ngram_quality import ngram_quality
from .pii import personal_data, written
from .pu_toxicity import pu_toxicity
from .sentencepiece_sampling import sampled_and_decoded
from .substring_dedup import substring_digests
from .token_files import read_tokens, write_tokens
from .url_filter import rule_table, url_filter
from .vector_codes import vector_codes


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op2_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_quality(table(spark, sf_dir, "documents"))


def op3_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), shingle=4, percent=85)


#: (verdict, host, path)
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in ("email", "ip", "card", "phone")), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


#: The piece model's file; a parameter of the operator.
PIECE_MODEL = os.environ.get("MERIDIAN_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op7_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_and_decoded(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op9_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digests(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: The tokenizer's file; a parameter of the operator.
TOKENIZER = os.environ.get("MERIDIAN_TOKENIZER", "/opt/tokenizers/word_bpe_49k.json")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder, TOKENIZER, end_id=1)
    return read_tokens(spark, folder, with_ids=False)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_ngram_quality": op2_ngram_quality,
    "op3_pu_toxicity": op3_pu_toxicity,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_url_filter": op5_url_filter,
    "op6_pii": op6_pii,
    "op7_sentencepiece_sampling": op7_sentencepiece_sampling,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_line_crf": op9_line_crf,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_files": op12_token_files,
    "op13_vector_codes": op13_vector_codes,
}


def _lloyd(rounds: int) -> str:
    """Assignments a0, a1, ... and codebooks c1, c2, ... from parts and c0."""
    assign = """, a{0} AS MATERIALIZED (SELECT id, p, min(struct_pack(d := d, e := e)) AS b FROM (
            SELECT x.id, x.p, c.e, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i]))) AS d FROM parts x JOIN c{0} c ON c.p = x.p) GROUP BY id, p)"""
    update = """, s{0} AS (SELECT x.p, a.b.e AS e, i, CAST(sum(x.v[i]) // count(*) - CASE WHEN sum(x.v[i]) % count(*) < 0 THEN 1 ELSE 0 END AS BIGINT) AS v
            FROM parts x JOIN a{0} a ON a.id = x.id AND a.p = x.p, range(1, 65) r(i) WHERE i <= len(x.v) GROUP BY ALL),
        c{1} AS (SELECT c.p, c.e, coalesce(n.v, c.v) AS v FROM c{0} c LEFT JOIN (SELECT p, e, list(v ORDER BY i) AS v FROM s{0} GROUP BY p, e) n ON n.p = c.p AND n.e = c.e)"""
    return "".join(assign.format(i) + update.format(i, i + 1) for i in range(rounds)) + assign.format(rounds)


ORACLE_SQL: dict[str, str] = {
    "op4_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        both_have AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT x, y FROM both_have JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
        u AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
        r(x, y) AS (SELECT x, y FROM u UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x),
        m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
        SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.y, w.doc_id)) AS component_id
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = w.doc_id""",
    "op5_url_filter": r"""
        WITH r(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        rest AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS x FROM pages),
        u AS (SELECT page_id, translate(regexp_extract(x, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        f AS (SELECT page_id, max(struct_pack(n := length(r.host || r.path), rule := r.host || r.path, verdict := r.verdict)) AS best
              FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY page_id)
        SELECT u.page_id, u.host, u.path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM u LEFT JOIN f USING (page_id)""",
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op10_substring_dedup": r"""
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        starts AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50),
        win AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS h FROM starts),
        bad AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS m FROM win) WHERE m < doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS i FROM bad),
        words AS (SELECT w.doc_id, u.i, w.ws[u.i] AS word FROM w, unnest(generate_series(1, len(w.ws))) AS u(i)),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op11_merkle_manifest": r"""
        WITH RECURSIVE tab(i, k, v) AS (SELECT i, 0, i::UBIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END FROM tab WHERE k < 8),
        crc(doc_id, rest, v) AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR), 4294967295::UBIGINT FROM documents WHERE doc_id IS NOT NULL
            UNION ALL SELECT doc_id, substr(rest, 2), xor(c.v // 256, t.v) FROM crc c JOIN tab t ON t.k = 8 AND t.i = xor(c.v, ascii(rest)::UBIGINT) % 256 WHERE rest <> ''),
        hit AS (SELECT doc_id FROM crc WHERE rest = '' AND v % 2 = 1),
        f AS (SELECT d.doc_id, source, text, CASE WHEN h.doc_id IS NULL THEN text ELSE replace(text, chr(10), '') END AS now,
              coalesce(strlen(CAST(d.doc_id AS VARCHAR)) || ':' || d.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS x
              FROM documents d LEFT JOIN hit h ON h.doc_id = d.doc_id),
        l AS (SELECT doc_id, source, sha256(x || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(x || coalesce(strlen(now) || ':' || now, '-')) AS bad FROM f),
        p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS size FROM l),
        n(source, lev, pos, h, size) AS (SELECT source, 0, pos, leaf, size FROM p UNION ALL SELECT source, lev + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (size + 2) // 3 FROM n WHERE size > 1 GROUP BY source, lev, pos // 3, size),
        subroots AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM n WHERE size = 1),
        m(lev, pos, h, size) AS (SELECT 0, pos, h, size FROM subroots UNION ALL SELECT lev + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (size + 2) // 3 FROM m WHERE size > 1 GROUP BY lev, pos // 3, size),
        step1 AS (SELECT a.source, a.lev, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lft, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS rgt
              FROM n a JOIN n b ON a.source IS NOT DISTINCT FROM b.source AND a.lev = b.lev AND a.pos // 3 = b.pos // 3 WHERE a.size > 1 GROUP BY a.source, a.lev, a.pos),
        step2 AS (SELECT a.lev, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lft, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS rgt
              FROM m a JOIN m b ON a.lev = b.lev AND a.pos // 3 = b.pos // 3 WHERE a.size > 1 GROUP BY a.lev, a.pos),
        fold1(doc_id, leaf, source, lev, pos, size, h, proof) AS (SELECT doc_id, leaf, source, 0, pos, size, bad, '' FROM p
            UNION ALL SELECT doc_id, leaf, g.source, g.lev + 1, g.pos // 3, (size + 2) // 3, sha256(lft || h || rgt), proof || lft || rgt FROM fold1 g JOIN step1 s ON s.source IS NOT DISTINCT FROM g.source AND s.lev = g.lev AND s.pos = g.pos WHERE size > 1),
        fold2(doc_id, leaf, subroot, lev, pos, size, h, proof) AS (SELECT doc_id, leaf, s.h, 0, s.pos, s.size, g.h, proof FROM fold1 g JOIN subroots s ON s.source IS NOT DISTINCT FROM g.source WHERE g.size = 1
            UNION ALL SELECT doc_id, leaf, subroot, g.lev + 1, g.pos // 3, (size + 2) // 3, sha256(lft || h || rgt), proof || lft || rgt FROM fold2 g JOIN step2 s ON s.lev = g.lev AND s.pos = g.pos WHERE size > 1),
        root AS (SELECT h AS root FROM m WHERE size = 1)
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM fold2, root WHERE size = 1""",
    "op13_vector_codes": f"""
        WITH k AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(floor(256e0 * x) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS MATERIALIZED (SELECT id, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS v FROM k, range(16) r(p)),
        c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY id) - 1 AS e, v FROM parts WHERE id IN (SELECT id FROM k ORDER BY id LIMIT 64)){_lloyd(2)},
        books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2),
        coded AS (SELECT id, string_agg(printf('%02x', b.e), '' ORDER BY p) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a2 GROUP BY id)
        SELECT id AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN k USING (id), books""",
}
