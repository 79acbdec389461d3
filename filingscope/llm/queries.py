"""Registered queries of the operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingscope.llm import (
    chat, decontaminate, fill_middle, jaccard, laesa, language, line_dedup, packing, pii, quality, rules, token_count, warc)
from filingscope.llm.store import fresh_folder, table

#: A key for the test tables; a corpus that is published needs one of its own, kept secret.
SURROGATE_KEY = b"key of the registered query"


def line_dedup_query(spark, d):
    out = line_dedup.line_report(table(spark, d, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def chat_query(spark, d):
    text = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.format_conversations(rows))


def rules_query(spark, d):
    return rules.judged(table(spark, d, "documents"), table(spark, d, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def warc_query(spark, d):
    path = fresh_folder(spark, "warc")
    warc.write_archives(table(spark, d, "pages"), path)
    return warc.read_archives(spark, path, with_payload=False).filter("record_type IS NOT NULL OR error IS NOT NULL").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def surrogate_query(spark, d):
    return pii.with_surrogates(table(spark, d, "documents"), SURROGATE_KEY)


def token_count_query(spark, d):
    return token_count.count_tokens(table(spark, d, "documents"))


def packing_query(spark, d):
    return packing.pack(table(spark, d, "documents"))


def quality_query(spark, d):
    return quality.quality_report(table(spark, d, "documents"), table(spark, d, "labels"))


def jaccard_query(spark, d):
    return jaccard.jaccard_groups(table(spark, d, "documents"), 4, 85)


def decontamination_query(spark, d):
    found = decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    items = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clustering_query(spark, d):
    return laesa.cluster_report(table(spark, d, "embeddings"))


def language_query(spark, d):
    return language.language_report(table(spark, d, "documents"))


def fill_middle_query(spark, d):
    out = fill_middle.transform(table(spark, d, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fill_middle.restored(), 256).alias("restored_sha256"))


QUERIES = {
    "op1_line_dedup": line_dedup_query,
    "op2_chat_trees": chat_query,
    "op3_warc": warc_query,
    "op4_best_fit_packing": packing_query,
    "op5_surrogates": surrogate_query,
    "op6_quality_vote": quality_query,
    "op7_jaccard_join": jaccard_query,
    "op8_decontamination": decontamination_query,
    "op9_token_counts": token_count_query,
    "op10_quality_rules": rules_query,
    "op11_laesa_clusters": clustering_query,
    "op12_language_mixture": language_query,
    "op13_fill_middle": fill_middle_query,
}

_MARKED = r"<(?:\||/?s>|</?SYS>>|unk>|pad>|bos>|eos>|start_of_turn>|end_of_turn>)|\[/?INST\]"

_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"



def _clusters_sql(k: int = laesa.CENTROIDS, rounds: int = laesa.ROUNDS) -> str:
    """Every vector against every centroid, round by round."""
    parts = ["""v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER () AS r
   FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND abs(CAST(x AS DOUBLE)) < 2097152)) = 64)""",
             "e AS (SELECT r, vec_id, unnest(range(64)) AS i, unnest(v) AS x FROM v)",
             f"""c0 AS (SELECT h.c, e.i, e.x FROM e JOIN (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, vec_id, v) - 1 AS c
   FROM v QUALIFY c < {k}) h ON h.r = e.r)"""]
    for t in range(rounds + 1):
        parts.append(f"d{t} AS (SELECT r, c, sum((e.x - c{t}.x) * (e.x - c{t}.x)) AS d FROM e JOIN c{t} USING (i) GROUP BY r, c)")
        parts.append(f"a{t} AS (SELECT r, c, d FROM d{t} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if t < rounds:
            parts.append(f"m{t} AS (SELECT a{t}.c, i, sum(x) AS s, count(*) AS n FROM e JOIN a{t} USING (r) GROUP BY a{t}.c, i)")
            parts.append(f"c{t + 1} AS (SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM c{t} LEFT JOIN m{t} USING (c, i))")
    return "WITH " + ",\n ".join(parts) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN (SELECT c, sha256(string_agg(CAST(x AS BIGINT), ',' ORDER BY i)) AS sha FROM c{rounds} GROUP BY c) s ON s.c = a.c"""


ORACLES = {
    "op11_laesa_clusters": _clusters_sql(),
    "op13_fill_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 h AS (SELECT *, len(w) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
 c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
   CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
 p AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p""",
    "op2_chat_trees": f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
   UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
 e AS (SELECT *, length(text) + length(text) - length(replace(text, chr(92), '')) + len(regexp_extract_all(text, '{_MARKED}'))
     + length(role) + length(role) - length(replace(role, chr(92), '')) + len(regexp_extract_all(role, '{_MARKED}'))
     + 5 * (length(role) - length(replace(role, chr(10), ''))) + 17 AS chars FROM r),
 g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
     coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars FROM g""",
    "op7_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format(text="coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 85 * (p.n + q.n - o)),
 l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
 r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.doc_id)
SELECT r.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op8_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format(text="coalesce(text, '')")}, '{_LETTERS}') AS w FROM documents),
 b AS (SELECT item_id, w, least(len(w), 10) AS m FROM (SELECT item_id, regexp_extract_all({_LOWER.format(text="coalesce(text, '')")}, '{_LETTERS}') AS w FROM benchmark) WHERE len(w) > 0),
 v AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
 x AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT m FROM v) WHERE len(w) >= m)),
 h AS (SELECT x.doc_id, x.i, x.m, v.item_id FROM x JOIN v ON v.m = x.m AND v.g = x.g),
 p AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY doc_id),
 t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
 c AS (SELECT html, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY html HAVING count(*) > 1)
SELECT page_id, strlen(p.html) AS payload_bytes, sha256(p.html) AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM p LEFT JOIN c ON c.html = p.html""",
    "op1_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
 k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
 s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
 m AS (SELECT k.*, s.last IS NOT NULL AND s.last <> doc_id AS gone FROM k LEFT JOIN s ON s.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
}
