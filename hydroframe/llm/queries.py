"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.llm import audit, bpe, decontam, dedup, html, idfile, jaccard, langid, quality, secretscan, topk, trie, unigram
from hydroframe.llm.textkit import table, tokenizer_path


OP3_SQL = """
WITH v AS (
    SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS w FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
      AND len([x FOR x IN embedding IF NOT isfinite(x)]) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
    SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), reach AS (
    SELECT doc_id AS id, doc_id AS c FROM d UNION SELECT l.v, r.c FROM reach r JOIN links l ON l.u = r.id WHERE r.c < l.v
)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM d JOIN reach r ON r.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP8_SQL = f"""
WITH item AS (
    SELECT item_id, regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), win AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS k
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM item WHERE len(w) > 0)
), d AS (
    SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d
), hits AS (
    SELECT p.doc_id, p.i, win.n, win.item_id FROM p CROSS JOIN (SELECT DISTINCT n FROM win) l JOIN win ON win.n = l.n AND win.k = array_to_string(p.w[p.i:p.i + l.n - 1], ' ') WHERE p.i + l.n - 1 <= len(p.w)
), words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


OP11_SQL = """
WITH RECURSIVE t AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents
), d AS (
    SELECT doc_id, part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS m
    FROM t
), l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), c AS (SELECT part, m, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM d LEFT JOIN l USING (doc_id)
), o AS (
    SELECT '' AS filter_order, 0 AS done, 0 AS step, 0 AS bit, 0 AS before
    UNION ALL SELECT filter_order || chr((65 + f)::INT), done | (1 << f)::INT, step + 1, (1 << f)::INT, done FROM o, range(5) r(f) WHERE done & (1 << f)::INT = 0
), steps AS (
    SELECT a.filter_order, b.step, b.bit, b.before FROM o a JOIN o b ON a.step = 5 AND b.step > 0 AND starts_with(a.filter_order, b.filter_order)
), s AS (
    SELECT part, filter_order, step, bit, count(*) FILTER (m & (before | bit) = 0) AS kept, count(*) FILTER (m & before = 0 AND m & bit <> 0) AS removed, count(*) FILTER (m & before <> 0 AND m & bit <> 0) AS redundant,
        count(*) FILTER (m = bit) AS unique_fails, count(*) FILTER (m & before = 0 AND m & bit <> 0 AND good) AS good_lost, count(*) FILTER (m & before = 0 AND m & bit <> 0 AND toxic) AS toxic_lost
    FROM c CROSS JOIN steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM s
"""

OP12_SQL = """
WITH k AS (
    SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS h FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size, row_number() OVER w = 1 AS kept, h AS text_sha256
FROM k WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""


OP13_SQL = """
WITH own AS (
    SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(concat_ws(':', length(coalesce(role, '')), coalesce(role, ''), coalesce(text, '')))) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), crc AS (
    SELECT c, t, (xor(list_reduce([4294967295] || flatten([[ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(c::VARCHAR, '')]), lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295) % 4)::INT AS h FROM own
), paths AS (SELECT o.c, coalesce(b.t, [])[1:o.h] || o.t[o.h + 1:] AS p FROM crc o LEFT JOIN own b ON b.c = o.c - o.c % 20
), steps AS (SELECT c, p, unnest(range(0, len(p) + 1)) AS d FROM paths
), node AS (
    SELECT p[1:d] AS k, d, min(c) AS conv_id, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(p) = d), '') AS ends,
        (count(*) - 1) * (CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(any_value(p[d].t), '[^\\x20\\x09-\\x0D]+')) END) AS saved
    FROM steps GROUP BY p[1:d], d
), kids AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL
), ends AS (SELECT node.*, coalesce(kids.n, 0) AS kids FROM node LEFT JOIN kids ON kids.k = node.k AND kids.d = node.d
), up AS (SELECT k[1:a] AS k, a AS d, count(*) FILTER (kids = 0) AS leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM ends) GROUP BY ALL)
SELECT e.conv_id, e.d::BIGINT AS depth, p.conv_id AS parent_conv_id, e.n AS n_convs, e.kids AS n_children, up.leaves AS n_leaves, up.saved::BIGINT AS saved_tokens, sha256(e.ends) AS ends_sha256
FROM ends e JOIN up ON up.k = e.k AND up.d = e.d LEFT JOIN node p ON p.d = e.d - 1 AND p.k = e.k[1:e.d - 1]
"""


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return unigram.counts(docs, tokenizer_path("piece_bpe_32k.model")).drop("text")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = idfile.IdFiles.write(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return files.checksums()


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(quality.sampled(docs, quality.graded(table(spark, sf_dir, "labels"))), levels=3)
    return quality.rate(docs, model, good=2, least=0.5).drop("text")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), size=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.train(docs.where("not held_out"))
    return langid.identify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = secretscan.scan(docs, secretscan.train())
    return found.select("doc_id", "n_secrets", "secrets", F.sha2(F.coalesce("clean_text", F.lit("")).cast("binary"), 256).alias("clean_sha256"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), part="lang")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents, by a hash of the doc_id, are the history; the other half is delivered to it."""
    first = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return dedup.classes(table(spark, sf_dir, "documents"), first).drop("repeats_history")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(trie.rebuilt(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_exact_topk": op3_exact_topk,
        "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
        "op5_html_extraction": op5_html_extraction,
        "op6_token_id_files": op6_token_id_files,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_benchmark_decontamination": op8_benchmark_decontamination,
        "op9_language_id": op9_language_id,
        "op10_secret_scan": op10_secret_scan,
        "op11_filter_audit": op11_filter_audit,
        "op12_exact_dedup": op12_exact_dedup,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_topk": OP3_SQL, "op4_ngram_jaccard_join": OP4_SQL, "op8_benchmark_decontamination": OP8_SQL, "op11_filter_audit": OP11_SQL, "op12_exact_dedup": OP12_SQL, "op13_prefix_trie": OP13_SQL}
