"""Queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .disclosure import personal_data

    return personal_data(_table(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nbsvm import quality_scores

    return quality_scores(_table(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cdc import fingerprints

    return fingerprints(_table(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .debruijn import drop_repeated_words

    return drop_repeated_words(_table(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .training_order import materialised

    return materialised(_table(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fm import toxicity_scores

    return toxicity_scores(_table(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(_table(spark, sf_dir), _table(spark, sf_dir, "benchmark")).drop("key")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_components

    found = near_components(_table(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed_rows

    return mixed_rows(_table(spark, sf_dir)).select("doc.doc_id", "doc.source", "tokens", "source_budget", "pass", "block", "position")


def op10_long_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .longmatch import drop_long_matches

    return drop_long_matches(_table(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {f.__name__: f for f in (op1_pii, op2_quality, op3_fingerprints, op4_substring_dedup, op5_training_order, op6_toxicity, op7_decontamination, op8_simhash_near_dedup, op9_mixing, op10_long_matches)}
_WORDS = "w AS (SELECT doc_id, list_filter(regexp_split_to_array(COALESCE(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS ws FROM documents)"

def _runs(table: str, key: str) -> str:
    """Lower-cased runs of letters and digits of a table's texts, as a list w."""
    return f"SELECT {key}, list_filter(regexp_split_to_array(lower(COALESCE(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {table}"


_LEAKS = (
    f"WITH d AS ({_runs('documents', 'doc_id')}), b AS ({_runs('benchmark', 'item_id')}), bn AS (SELECT item_id, w, len(w) AS n, LEAST(len(w), 5) AS k FROM b WHERE len(w) > 0), "
    "bs AS (SELECT item_id, n, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS q FROM (SELECT *, unnest(range(1, n - k + 2)) AS i FROM bn)), "
    "ks AS (SELECT DISTINCT k FROM bn), ds AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS q FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN ks WHERE len(w) >= k)), "
    "c AS (SELECT doc_id, item_id, bs.n, bs.k FROM ds JOIN bs ON ds.q = bs.q AND ds.k = bs.k GROUP BY doc_id, item_id, bs.n, bs.k HAVING COUNT(DISTINCT bs.i) >= 0.8 * (bs.n - bs.k + 1)), "
    "wn AS (SELECT c.doc_id, item_id, n, k, LEAST(n, len(w)) AS m, unnest(range(0, GREATEST(len(w) - n, 0) + 1)) AS s FROM c JOIN d ON d.doc_id = c.doc_id), "
    "wc AS (SELECT wn.doc_id, item_id, s, q, COUNT(*) AS x FROM wn JOIN ds ON ds.doc_id = wn.doc_id AND ds.k = wn.k AND i BETWEEN s + 1 AND s + m - wn.k + 1 GROUP BY wn.doc_id, item_id, s, q), "
    "bc AS (SELECT item_id, q, COUNT(*) AS y FROM bs GROUP BY item_id, q), "
    "h AS (SELECT wc.doc_id, wc.item_id, s, SUM(LEAST(x, y)) AS z FROM wc JOIN bc ON bc.item_id = wc.item_id AND bc.q = wc.q GROUP BY wc.doc_id, wc.item_id, s), "
    "j AS (SELECT h.doc_id, h.item_id, n, h.s, CAST(z AS DOUBLE) / (m - k + 1 + n - k + 1 - z) AS sim FROM h JOIN wn ON wn.doc_id = h.doc_id AND wn.item_id = h.item_id AND wn.s = h.s), "
    "r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, item_id ORDER BY sim DESC, s) AS o FROM j WHERE sim >= 0.8) "
    "SELECT doc_id, item_id, sim AS similarity, CAST(s AS INTEGER) AS start_word, CAST(n AS INTEGER) AS n_words FROM r WHERE o = 1"
)


_PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9](?:[ -]?[0-9])+", r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = r"[\p{L}]{3,}"
_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_PII = (
    "WITH t AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents), "
    + "a AS ("
    + " UNION ALL ".join(f"SELECT doc_id, {i} AS kind, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS gs FROM t" for i, p in enumerate(_PLAIN))
    + "), u AS (SELECT doc_id, kind, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM a), "
    "p AS (SELECT doc_id, kind, i, ms[i] AS value, right(gs[i], 160) AS bef, left(gs[i + 1], 160) AS aft, SUM(length(gs[i]) + length(ms[i])) OVER (PARTITION BY doc_id, kind ORDER BY i) AS en FROM u), "
    f"f AS (SELECT *, en - length(value) AS st FROM p WHERE CASE kind WHEN 0 THEN TRUE WHEN 1 THEN len(list_filter(string_split(value, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST(right(x, 3) AS INTEGER) > 255)) = 0 "
    f"WHEN 2 THEN length({_DIGITS}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), j, 1) AS INTEGER) ELSE (2 * CAST(substr(reverse({_DIGITS}), j, 1) AS INTEGER)) % 10 + CAST(substr(reverse({_DIGITS}), j, 1) AS INTEGER) // 5 END)) % 10 = 0 ELSE length({_DIGITS}) BETWEEN 8 AND 15 END), "
    f"l AS (SELECT *, CASE kind WHEN 0 THEN lower(value) WHEN 1 THEN value ELSE {_DIGITS} END AS own, regexp_extract_all(lower(bef), '{_TERM}') AS x, regexp_extract_all(lower(aft), '{_TERM}') AS y, length(bef) >= 160 AS cx, length(aft) >= 160 AS cy FROM f), "
    "n AS (SELECT doc_id, kind, st, [kind || ':' || own, kind || '~' || CASE kind WHEN 0 THEN split_part(own, '@', 2) WHEN 1 THEN split_part(own, '.', 1) || '.' || split_part(own, '.', 2) WHEN 2 THEN left(own, 6) ELSE left(own, 4) END, CAST(kind AS VARCHAR)] AS es, list_concat(list_slice(list_reverse(CASE WHEN cx THEN list_slice(x, 2, len(x)) ELSE x END), 1, 8), list_slice(CASE WHEN cy THEN list_slice(y, 1, len(y) - 1) ELSE y END, 1, 8)) AS near FROM l), "
    "m AS (SELECT doc_id, entity, arg_min(near, st) AS ctx FROM (SELECT doc_id, st, array_to_string(near, ' ') AS near, unnest(es) AS entity FROM n) GROUP BY doc_id, entity), "
    "e AS (SELECT entity, COUNT(*) AS ne FROM m GROUP BY entity HAVING COUNT(DISTINCT ctx) >= 3), "
    f"b AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{_TERM}')) AS term FROM t), "
    f"d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(regexp_replace(text, '{_PLAIN[0]}', ' ', 'g')), '{_TERM}')) AS term FROM t WHERE doc_id IN (SELECT doc_id FROM m)), "
    "r AS (SELECT term, m.entity, ne, COUNT(*) AS te FROM m JOIN e ON e.entity = m.entity JOIN d ON d.doc_id = m.doc_id GROUP BY term, m.entity, ne HAVING COUNT(DISTINCT ctx) >= 3), "
    "h AS (SELECT term, COUNT(*) AS nt FROM b GROUP BY term), "
    "c AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM t), "
    "g AS (SELECT DISTINCT r.term FROM r JOIN h ON h.term = r.term CROSS JOIN c WHERE n > ne AND te * ln(n * te / (CAST(nt AS DOUBLE) * ne)) - te + nt * ne / n >= ln((SELECT COUNT(*) FROM r) * 100.0) AND ln(n * te / (CAST(nt AS DOUBLE) * ne)) / ln(n / ne) >= 0.6), "
    f"w AS (SELECT doc_id, regexp_extract_all(text, '{_TERM}') AS ms, string_split_regex(text, '{_TERM}') AS gs FROM t WHERE EXISTS (SELECT 1 FROM g)), "
    "v AS (SELECT doc_id, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM w), "
    "z AS (SELECT doc_id, ms[i] AS value, SUM(length(gs[i]) + length(ms[i])) OVER (PARTITION BY doc_id ORDER BY i) AS en FROM v), "
    "o AS (SELECT z.doc_id, 4 AS kind, en - length(value) AS st, en FROM z JOIN g ON g.term = lower(value)), "
    "s AS (SELECT doc_id, kind, st, en FROM f UNION ALL SELECT doc_id, kind, st, en FROM o WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = o.doc_id AND o.st < f.en AND f.st < o.en)), "
    "k AS (SELECT doc_id, COUNT(*) FILTER (kind = 0) AS n_email, COUNT(*) FILTER (kind = 1) AS n_ip, COUNT(*) FILTER (kind = 2) AS n_card, COUNT(*) FILTER (kind = 3) AS n_phone, "
    "string_agg(CASE WHEN kind < 4 THEN list_extract(['email', 'ip', 'card', 'phone'], kind + 1) || ':' || st || ':' || en END, ',' ORDER BY kind, st) AS base, string_agg(list_extract(['email', 'ip', 'card', 'phone', 'term'], kind + 1) || ':' || st || ':' || en, ',' ORDER BY kind, st) AS spans FROM s GROUP BY doc_id) "
    "SELECT t.doc_id, COALESCE(n_email, 0) AS n_email, COALESCE(n_ip, 0) AS n_ip, COALESCE(n_card, 0) AS n_card, COALESCE(n_phone, 0) AS n_phone, sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans FROM t LEFT JOIN k ON k.doc_id = t.doc_id"
)

_LONG = (
    "WITH t AS (SELECT doc_id, encode(COALESCE(text, '')) AS b, octet_length(encode(COALESCE(text, ''))) AS n FROM documents), "
    "g AS (SELECT doc_id, i, md5(b[i + 1:i + 400]) AS h FROM (SELECT doc_id, b, unnest(range(0, n - 399)) AS i FROM t WHERE n >= 400)), "
    "c AS (SELECT h FROM g GROUP BY h HAVING COUNT(*) > 1), s AS (SELECT doc_id, i FROM g SEMI JOIN c ON g.h = c.h), "
    "m AS (SELECT doc_id, i, SUM(f) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT doc_id, i, CASE WHEN i <= LAG(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS f FROM s)), "
    "r AS (SELECT doc_id, MIN(i) AS lo, MAX(i) + 400 AS hi FROM m GROUP BY doc_id, r), "
    "p AS (SELECT doc_id, lo, hi, COALESCE(LAG(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS fr FROM r UNION ALL SELECT t.doc_id, t.n, t.n, COALESCE(MAX(hi), 0) FROM t LEFT JOIN r ON r.doc_id = t.doc_id GROUP BY t.doc_id, t.n) "
    "SELECT t.doc_id, CAST(MAX(n) AS BIGINT) AS n_bytes, CAST(SUM(hi - lo) AS BIGINT) AS n_removed, COUNT(*) - 1 AS n_spans, sha256(unhex(string_agg(hex(CASE WHEN lo > fr THEN b[fr + 1:lo] ELSE encode('') END), '' ORDER BY fr, lo))) AS kept_sha256 FROM t JOIN p ON p.doc_id = t.doc_id GROUP BY t.doc_id"
)
ORACLE_SQL: dict[str, str] = {
    "op4_substring_dedup": f"WITH {_WORDS}, p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w), "
    "g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS q FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)), "
    "m AS (SELECT q, MIN(doc_id) AS least FROM g GROUP BY q), h AS (SELECT doc_id, i FROM g JOIN m ON g.q = m.q WHERE least < doc_id), "
    "r AS (SELECT DISTINCT doc_id, i + j AS i FROM h CROSS JOIN (SELECT unnest(range(0, 13)) AS j)), "
    "k AS (SELECT p.doc_id, COUNT(r.i) AS gone, string_agg(CASE WHEN r.i IS NULL THEN word END, ' ' ORDER BY p.i) AS line FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.i = p.i GROUP BY p.doc_id) "
    "SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, COALESCE(gone, 0) AS n_removed, sha256(COALESCE(line, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id",
    "op1_pii": _PII,
    "op10_long_matches": _LONG,
    "op7_decontamination": _LEAKS,
}
