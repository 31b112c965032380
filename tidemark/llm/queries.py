"""The queries opN_<name>, each a thin wrapper that binds an operator to its production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe_replay import bpe_digests
from tidemark.llm.cap_filters import embedding_links
from tidemark.llm.decontaminate import contaminated
from tidemark.llm.divergence import source_divergence
from tidemark.llm.html_text import extract_text
from tidemark.llm.language_id import language_id
from tidemark.llm.language_model import score_texts
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.ngram_join import ngram_jaccard_join
from tidemark.llm.packing import best_fit_packing
from tidemark.llm.resample import importance_resample
from tidemark.llm.secret_scan import scan_secrets
from tidemark.llm.token_counts import token_counts
from tidemark.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), k=3, percent=90)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_html_extraction": op2_html_extraction,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_language_id": op7_language_id,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_line_dedup": op9_line_dedup,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_source_divergence": op11_source_divergence,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_importance_resample": op13_importance_resample,
}
#: Words are runs between the six white space bytes, letters A to Z in lower case.
_WORDS = r"SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents"
#: Words of digits, letters in lower case and characters beyond ASCII.
_RUNS_OF = r"regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _runs(table: str) -> str:
    """All runs of one to three words ``w`` of each row ``r``."""
    return f"SELECT r, unnest(list_concat(list_transform(range(1, len(w) + 1), lambda i: w[i]), list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM {table}"


ORACLE_SQL: dict[str, str] = {
    "op10_ngram_jaccard_join": f"WITH RECURSIVE w AS ({_WORDS}), sh AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 2, 1) + 1), lambda i: array_to_string(ws[i:i + 2], chr(31)))) AS s FROM w WHERE len(ws) > 0), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), "
    "pr AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL), lk AS (SELECT x, y FROM pr JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)), "
    "r AS (SELECT doc_id AS node, doc_id AS comp FROM documents UNION SELECT lk.y, r.comp FROM r JOIN lk ON lk.x = r.node) SELECT r.node AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(comp) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.node GROUP BY r.node",
    "op11_source_divergence": r"WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents), "
    r"t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d), "
    r"c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL), "
    r"k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3), "
    r"v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY ALL), "
    r"g AS (SELECT DISTINCT lang, source FROM d), "
    r"e AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term), "
    r"s AS (SELECT lang, source, sum(n) AS total FROM e GROUP BY ALL), "
    r"p AS (SELECT e.lang, e.source, e.term, e.n, (1 + 1000000000::HUGEINT * (e.n + 1) // (s.total + v.v))::BIGINT AS p FROM e JOIN s ON s.lang = e.lang AND s.source = e.source JOIN v ON v.lang = e.lang), "
    r"q AS (SELECT k.lang, k.term, (1 + 1000000000::HUGEINT * (k.n + 1) // (v.total + v.v))::BIGINT AS q FROM k JOIN v ON v.lang = k.lang), "
    r"w AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL), "
    r"f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(w.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN w ON w.lang = a.lang AND w.source = a.source AND w.item = b.source "
    r"UNION ALL SELECT p.lang, p.source, 'term', p.term, (p.p - q.q) * (p.p - q.q) // q.q FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q) "
    r"SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INT AS rank FROM f QUALIFY part = 'pair' OR rank <= 200",
    # the checksum is worked out from its table of 256 numbers, which the polynomial gives
    "op13_importance_resample": "WITH RECURSIVE st(i, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM st WHERE k < 8), "
    "tb AS (SELECT list(c ORDER BY i) AS tab FROM st WHERE k = 8), "
    f"d AS (SELECT row_number() OVER () AS r, doc_id, list_filter({_RUNS_OF}, lambda x: x <> '') AS w FROM documents), "
    f"b AS (SELECT row_number() OVER () AS r, list_filter({_RUNS_OF}, lambda x: x <> '') AS w FROM benchmark), "
    f"df AS ({_runs('d')}), bf AS ({_runs('b')}), "
    "u AS (SELECT DISTINCT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION ALL SELECT f FROM bf)), "
    "v AS (SELECT f, list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda k: (strpos('0123456789ABCDEF', x[2 * k + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * k + 2]) - 1)) AS y FROM u), "
    "h AS (SELECT f, xor(list_reduce(y, lambda a, e: xor(a >> 8, tab[(xor(a, e) & 255) + 1])), 4294967295) % 10000 AS bucket FROM v, tb), "
    "s AS (SELECT bucket, count(*) AS n FROM df JOIN h USING (f) GROUP BY 1), t AS (SELECT bucket, count(*) AS n FROM bf JOIN h USING (f) GROUP BY 1), "
    "g AS (SELECT range AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM range(10000) LEFT JOIN s ON s.bucket = range LEFT JOIN t ON t.bucket = range), "
    "w AS (SELECT r, count(*) AS n, sum(gain) AS weight FROM df JOIN h USING (f) JOIN g USING (bucket) GROUP BY r), "
    "o AS (SELECT d.doc_id, len(d.w) >= 20 AS able, coalesce(w.n, 0) AS n_features, coalesce(w.weight, 0)::BIGINT AS weight, coalesce(w.weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w ON w.r = d.r) "
    "SELECT doc_id, n_features, weight, score, CASE WHEN able AND k <= 5 * (SELECT count(*) FROM o WHERE able) // 100 THEN k END AS rank FROM (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST) AS k FROM o)",
}
